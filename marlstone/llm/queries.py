"""Queries of the training-data operators over their whole tables, and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import current_clips, small, squeezed
from marlstone.llm.packing import CAPACITY, pack
from marlstone.llm.percentiles import bisect, combined, located, long_values, summaries
from marlstone.llm.quality import deciding_rule, document_stats, prose_rule
from marlstone.llm.runs import collapse_runs
from marlstone.llm.sampling import pivotal_sample, strata_report
from marlstone.llm.splits import assign_splits, entity_groups, split_name, torn_entities
from marlstone.llm.tokens import DEFAULT_TOKENIZER, byte_letters, decode, encode
from marlstone.llm.topn import top_n
from marlstone.llm.truncation import cut_rows
from marlstone.session import stored, table

SQL_SQUEEZE = r"lower(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
SQL_CURRENT = f"""
current_clips AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY vid, clip_index ORDER BY landed_at DESC NULLS LAST, clip_row DESC) AS rn
    FROM (SELECT *, {SQL_SQUEEZE.format("video_id")} AS vid FROM stages) WHERE vid IS NOT NULL AND clip_index IS NOT NULL)
  WHERE rn = 1)"""


#: Rows of a table of targets; so many strata at most reach the driver or are broadcast.
MOST_TARGETS = 10_000


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return cut_rows(table(spark, d, "stages"), "clip_row", "vlm_description", "source")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).where("cut").select(F.col("id").alias("clip_row"))


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    """Texts, cut texts and their share per source (null source as a group)."""
    n = F.count(F.lit(1))
    return _cut(spark, d).groupBy("source").agg(n.alias("texts"), F.count_if("cut").alias("cut_texts"), (F.count_if("cut") / n).alias("share"))


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    return collapse_runs(table(spark, d, "lerobot_datasource"), "episode_index", "frame_index", "timestamp", ["state", "action"], "logged_at", least=least)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 2).select("episode_index", F.col("first").alias("first_frame"), F.col("last").alias("last_frame"))


def p2_events(spark: SparkSession, d: str) -> DataFrame:
    """Every run, single frames included, with its count and duration."""
    return _runs(spark, d, 1).select("episode_index", F.col("first").alias("first_frame"), F.col("last").alias("last_frame"), F.col("n").alias("frames"), F.round("duration", 6).alias("duration_sec"), "clock_steps_back")


def _strata(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    """Eligible current clips with their stratum, and the targets table (22 rows)."""
    targets = sorted((r.asDict() for r in small(table(spark, d, "sample_targets"), MOST_TARGETS)), key=lambda t: (t["category"] or "", t["is_safe"] or False))
    names = spark.createDataFrame([(t["category"], t["is_safe"], i) for i, t in enumerate(targets)], "category string, is_safe boolean, stratum int")
    clips = current_clips(table(spark, d, "stages"), "category", "is_safe").withColumn("category", squeezed("category"))
    return stored(clips.join(F.broadcast(names), ["category", "is_safe"]), "eligible"), targets


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    eligible, targets = _strata(spark, d)
    short = [(t["category"], int(t["is_safe"])) for t in strata_report(eligible, ["category", "is_safe"], targets) if t["short"]]
    return spark.createDataFrame(short, "category string, is_safe int")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampled clips with their inclusion probability."""
    eligible, targets = _strata(spark, d)
    report = strata_report(eligible, ["category", "is_safe"], targets)
    probs = spark.createDataFrame([(t["stratum"], t["p"]) for t in report], "stratum int, p double")
    rows = eligible.join(F.broadcast(probs), "stratum")
    taken = pivotal_sample(rows.select(F.col("clip_row").alias("id"), "stratum", "p"), sum(t["eligible"] for t in report))
    return rows.join(taken, rows["clip_row"] == taken["id"], "left_semi").select("clip_row", "video_id", "clip_index", "category", F.col("is_safe").cast("int").alias("is_safe"), "p")


def p3_taken(spark: SparkSession, d: str) -> DataFrame:
    """Whether each stratum's rows in the sample come to within one of its reachable
    total, and the rows of the whole sample."""
    eligible, targets = _strata(spark, d)
    report = strata_report(eligible, ["category", "is_safe"], targets)
    wanted = spark.createDataFrame([(t["category"], int(t["is_safe"]), t["eligible"], t["reachable"]) for t in report], "category string, is_safe int, eligible bigint, reachable double")
    taken = p3_sample(spark, d).groupBy("category", "is_safe").agg(F.countDistinct("clip_row").alias("taken"))
    rows = stored(wanted.join(taken, ["category", "is_safe"], "left").withColumn("taken", F.coalesce("taken", F.lit(0))), "taken")
    total = rows.agg(F.sum("taken").alias("sample_rows"))
    return rows.join(F.broadcast(total)).select("category", "is_safe", "eligible", (F.abs(F.col("taken") - F.col("reachable")) < 1 + 1e-6).alias("close"), "sample_rows")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per stratum: eligible clips, target, rows it can get, gap to the target."""
    eligible, targets = _strata(spark, d)
    rows = [(t["category"], int(t["is_safe"]), t["eligible"], t["sample_size"], t["wanted"], round(t["reachable"], 3), round(max(0.0, t["wanted"] - t["reachable"]), 3), int(t["short"])) for t in strata_report(eligible, ["category", "is_safe"], targets)]
    return spark.createDataFrame(rows, "category string, is_safe int, eligible bigint, sample_size bigint, wanted double, reachable double, gap double, short int")


METRICS = {"brightness": "brightness >= 0", "contrast": "contrast > 0", "sharpness": "sharpness >= 0"}
PERMILLES = [10, 50, 250, 500, 750, 950, 990]


def _metric_values(spark: SparkSession, d: str) -> DataFrame:
    """category (trimmed, lower-cased, null stays a group), day, metric, value of every
    valid measurement: a projection, read anew by each pass."""
    stages = table(spark, d, "stages").select(squeezed("category").alias("category"), F.to_date("processed_at").alias("day"), *METRICS)
    return long_values(stages, ["category", "day"], METRICS)


def _with_bounds(exact: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """The exact percentiles with the interval that the summaries alone give."""
    bounds = start.withColumnsRenamed({k: f"_{k}" for k in [*keys, "permille"]})
    on = [exact[k].eqNullSafe(bounds[f"_{k}"]) for k in [*keys, "permille"]]
    return exact.join(bounds, on).select(*keys, "permille", exact["total"], "value", F.col("lo").alias("summary_low"), F.col("hi").alias("summary_high"))


def _overall(values: DataFrame, daily: DataFrame) -> DataFrame:
    keys = ["category", "metric"]
    start = stored(located(combined(daily, keys), keys, PERMILLES), "located")
    return _with_bounds(bisect(values, start, keys), start, keys)


def p4_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of each single day and, with a null day, of all days
    together, and the interval that the (combined) summaries alone give."""
    keys, values = ["day", "category", "metric"], _metric_values(spark, d)
    daily = stored(summaries(values, keys), "daily")
    start = stored(located(daily.where("day is not null"), keys, PERMILLES), "located")
    return _with_bounds(bisect(values, start, keys), start, keys).unionByName(_overall(values, daily).withColumn("day", F.lit(None).cast("date")))


def p4_daily(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of single days; they add up over any set of days."""
    return summaries(_metric_values(spark, d), ["day", "category", "metric"])


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles over all days, with the interval known from the
    combined daily summaries alone."""
    values = _metric_values(spark, d)
    return _overall(values, stored(summaries(values, ["day", "category", "metric"]), "daily"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    clips = stored(current_clips(table(spark, d, "stages"), "sharpness", "motion_score"), "clips").where("sharpness >= 0 and not isnan(sharpness)")
    best = top_n(clips.select("video_id", "clip_index", "sharpness", "motion_score"), ["video_id"], "sharpness", 3, [("motion_score", True), ("clip_index", False)])
    return best.select("video_id", "clip_index")


def _entity_rows(spark: SparkSession, d: str) -> DataFrame:
    """kind, record, entity of every clip row and frame row."""
    clips = table(spark, d, "stages").select(F.lit("video").alias("kind"), F.col("clip_row").alias("record"), squeezed("video_id").alias("entity"))
    frames = table(spark, d, "lerobot_datasource").select(F.lit("episode").alias("kind"), F.col("index").alias("record"), F.col("episode_index").cast("string").alias("entity"))
    return clips.unionByName(frames)


def _split_targets(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return sorted((r["split_name"], r["target_permille"]) for r in small(table(spark, d, "split_targets"), MOST_TARGETS))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    names = [n for n, _ in _split_targets(spark, d)]
    draft = table(spark, d, "split_draft").select(squeezed("entity_kind").alias("kind"), F.col("record_id").alias("record"), split_name(F.col("split_name"), names).alias("split"))
    drafted = draft.where("record is not null").groupBy("kind", "record").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    links = stored(_entity_rows(spark, d).join(drafted, ["kind", "record"]), "links")
    named = links.select("kind", "entity", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("split"))
    torn = torn_entities(named, entity_groups(links))
    return torn.select(F.col("kind").alias("entity_kind"), F.col("entity").alias("entity_key"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every video and episode, with its rows."""
    rows = _entity_rows(spark, d).where("entity is not null")
    groups = entity_groups(rows)
    weights = rows.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("rows"))
    grouped = stored(weights.join(groups, ["kind", "entity"]), "grouped")
    placed = assign_splits(grouped.groupBy("kind", "component").agg(F.sum("rows").alias("weight")), _split_targets(spark, d))
    return grouped.join(placed, ["kind", "component"]).select(F.col("kind").alias("entity_kind"), F.col("entity").alias("entity_key"), "rows", F.col("split").alias("split_name"))


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every entity and the number of splits that hold any of them."""
    placed = p6_splits(spark, d).select(F.col("entity_kind").alias("kind"), F.col("entity_key").alias("entity"), "split_name")
    rows = _entity_rows(spark, d).join(placed, ["kind", "entity"])
    return rows.groupBy(F.col("kind").alias("entity_kind"), F.col("entity").alias("entity_key")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("split_name").alias("splits"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of each split, by kind."""
    rows = p6_splits(spark, d).groupBy("entity_kind", "split_name").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("entities"), F.max("rows").alias("largest"))
    total = rows.groupBy("entity_kind").agg(F.sum("rows").alias("total"))
    return rows.join(total, "entity_kind").select("entity_kind", "split_name", "rows", "entities", "largest", (F.col("rows") * 1000 / F.col("total")).alias("share_permille"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each text decoded from its ids again; a null text comes back empty."""
    ids = stored(encode(table(spark, d, "documents"), "doc_id", "text"), "ids")
    return decode(ids, "doc_id", F.col("ids"))


def _token_counts(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text", counts_only=True)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that must be split: those whose pieces the packing put into more than one
    container (a full piece fills one of its own)."""
    held = p8_containers(spark, d).where("pieces > 1").groupBy("doc_id").agg(F.min("container").alias("least"), F.max("container").alias("greatest"))
    return held.where("least < greatest").select("doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container and place of every piece of every document."""
    return pack(_token_counts(spark, d), "doc_id", "tokens")


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and tokens of every document, and whether its containers hold no more than
    their length, in places of their own."""
    placed = stored(p8_containers(spark, d), "placed")
    held = placed.groupBy("container").agg(F.sum("tokens").alias("held"), F.max("length").alias("length"), F.count(F.lit(1)).alias("n"), F.countDistinct("place").alias("places"))
    fits = held.select("container", ((F.col("held") <= F.col("length")) & (F.col("n") == F.col("places"))).alias("fits"))
    return placed.join(fits, "container").groupBy("doc_id").agg(F.countDistinct("piece").alias("pieces"), F.sum("tokens").alias("tokens"), F.every("fits").alias("fits"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and their fill by length."""
    bins = p8_containers(spark, d).groupBy("container", "length").agg(F.sum("tokens").alias("tokens"))
    return bins.groupBy("length").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens")).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("length")))


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    """All statistics of every document, and whether it is prose."""
    return document_stats(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words")).withColumn("rule", deciding_rule()).withColumn("prose", prose_rule())


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that plain counting gives, to 9 decimals."""
    shares = ["mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "digit_ratio", "duplicate_lines"]
    return p9_stats(spark, d).select("doc_id", "words", "lines", *[F.round(c, 9).alias(c) for c in shares])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_stats(spark, d).where("not prose").select("doc_id")


def p9_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The rules against the labels (some of which are wrong)."""
    labels = table(spark, d, "prose_labels").groupBy("doc_id").agg(F.min("label").alias("label"))
    joined = p9_stats(spark, d).select("doc_id", F.when(F.col("prose"), "prose").otherwise("other").alias("found")).join(labels, "doc_id")
    return joined.groupBy("label", "found").agg(F.count(F.lit(1)).alias("documents"))


_ALIKE = " AND ".join(f"abs({v}[{i}]::DOUBLE - (lag({v}) OVER w)[{i}]::DOUBLE) <= 0.002" for v, k in (("state", 4), ("action", 2)) for i in range(1, k + 1))
_RUNS = f"""
WITH frames AS (
  SELECT episode_index, frame_index, any_value(state) AS state, any_value(action) AS action, any_value("timestamp") AS t
  FROM lerobot_datasource WHERE episode_index IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1, 2),
marked AS (
  SELECT *, coalesce({_ALIKE}, false) AS alike FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
numbered AS (
  SELECT *, sum(CASE WHEN alike THEN 0 ELSE 1 END) OVER (PARTITION BY episode_index ORDER BY frame_index) AS run FROM marked)"""

_LETTERS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in byte_letters()) + "]"
_BLANK = r"\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}"
#: Every text cut into words (a mark splits the white space before a word) and each word's
#: leftmost pair of least rank contracted, one at a time, until none is left.
_BPE = rf"""
WITH RECURSIVE model AS (SELECT model.vocab AS vocab, model.merges AS merges FROM read_json('{DEFAULT_TOKENIZER}', columns = {{model: 'STRUCT(vocab MAP(VARCHAR, INTEGER), merges JSON)'}}, maximum_object_size = 100000000)),
vocab AS (SELECT unnest(map_keys(vocab)) AS piece, unnest(map_values(vocab)) AS id FROM model),
raw AS (SELECT unnest(CAST(merges AS JSON[])) AS m, generate_subscripts(CAST(merges AS JSON[]), 1) AS rank FROM model),
pairs AS (SELECT rank, CASE WHEN json_type(m) = 'ARRAY' THEN m ->> 0 ELSE split_part(m ->> '$', ' ', 1) END AS a, CASE WHEN json_type(m) = 'ARRAY' THEN m ->> 1 ELSE split_part(m ->> '$', ' ', 2) END AS b FROM raw),
rules AS MATERIALIZED (SELECT x.id AS first, y.id AS second, any_value(z.id) AS merged, min(rank) AS rank FROM pairs JOIN vocab x ON a = x.piece JOIN vocab y ON b = y.piece JOIN vocab z ON a || b = z.piece GROUP BY 1, 2),
byte_ids AS MATERIALIZED (SELECT list(id ORDER BY byte) AS of_byte FROM (SELECT unnest({_LETTERS}) AS piece, unnest(range(256)) AS byte) JOIN vocab USING (piece)),
marked AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(1114109), ''), '([{_BLANK}])([{_BLANK}][^{_BLANK}])', '\1' || chr(1114109) || '\2', 'g') AS t FROM documents),
cut AS (SELECT doc_id, regexp_extract_all(t, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}\x{{10fffd}}]+|[{_BLANK}]+') AS words FROM marked),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM cut),
known AS MATERIALIZED (SELECT word, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: of_byte[('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::INTEGER + 1]) AS ids FROM (SELECT DISTINCT word FROM placed), byte_ids),
steps(word, ids) USING KEY (word) AS (SELECT word, ids FROM known UNION
  SELECT word, list_concat(list_concat(list_slice(ids, 1, pos - 1), [merged]), list_slice(ids, pos + 2, len(ids))) FROM (
    SELECT word, ids, pos, merged, row_number() OVER (PARTITION BY word ORDER BY rank, pos) AS r FROM (SELECT word, ids, unnest(range(1, len(ids))) AS pos FROM steps) JOIN rules ON ids[pos] = first AND ids[pos + 1] = second) WHERE r = 1),
coded AS (SELECT doc_id, coalesce(flatten(list(flat ORDER BY pos) FILTER (flat IS NOT NULL)), []) AS ids FROM documents LEFT JOIN (SELECT doc_id, pos, ids AS flat FROM placed JOIN steps USING (word)) USING (doc_id) GROUP BY doc_id)"""
_VALUES = f"""
vals AS (
  SELECT {SQL_SQUEEZE.format("category")} AS category, processed_at::DATE AS day, m.metric, m.value FROM stages,
    LATERAL (SELECT unnest([{{'metric': 'brightness', 'value': CASE WHEN brightness >= 0 THEN brightness END}}, {{'metric': 'contrast', 'value': CASE WHEN contrast > 0 THEN contrast END}}, {{'metric': 'sharpness', 'value': CASE WHEN sharpness >= 0 THEN sharpness END}}], recursive := true)) m
  WHERE m.value IS NOT NULL AND NOT isnan(m.value))"""
#: Totals in proportion to the targets between floor and count, by bisection of their scale.
_REACHABLE = f"""
WITH RECURSIVE {SQL_CURRENT},
eligible AS (SELECT t.category, t.is_safe, count(c.vid) AS n, coalesce(any_value(t.min_rows), 0) AS min_rows, coalesce(any_value(t.target_permille), 0) AS permille
  FROM sample_targets t LEFT JOIN current_clips c ON {SQL_SQUEEZE.format("c.category")} = t.category AND c.is_safe = t.is_safe GROUP BY 1, 2),
sized AS MATERIALIZED (SELECT *, sum(n) OVER () // 10 AS size, least(min_rows, n)::DOUBLE AS low, permille / 1000.0::DOUBLE AS share FROM eligible),
scale(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1e12::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN total < size THEN mid ELSE lo END, CASE WHEN total < size THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, sum(CASE WHEN share > 0 THEN least(n, greatest(low, (lo + hi) / 2 * share)) ELSE low END) AS total, any_value(size) AS size FROM scale, sized GROUP BY i, lo, hi) WHERE i < 150),
reached AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN share > 0 THEN least(n, greatest(low, (SELECT hi FROM scale WHERE i = 150) * share)) ELSE low END AS reachable FROM sized)"""

QUERIES = {
    "p1_found": p1_found, "p1_sources": p1_sources,
    "p2_found": p2_found, "p2_events": p2_events, "p3_found": p3_found, "p3_sample": p3_sample, "p3_taken": p3_taken, "p3_report": p3_report, "p4_by_day": p4_by_day, "p4_percentiles": p4_percentiles, "p4_daily": p4_daily,
    "p5_found": p5_found, "p6_found": p6_found, "p6_splits": p6_splits, "p6_whole": p6_whole, "p6_shares": p6_shares,
    "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_found": p8_found, "p8_containers": p8_containers, "p8_whole": p8_whole, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_counts": p9_counts, "p9_stats": p9_stats, "p9_agreement": p9_agreement,
}
_WORD = r"[\p{L}\p{Nl}\p{No}]"
_COUNTS = rf"""
WITH seen AS (SELECT doc_id, regexp_replace(replace(replace(replace(replace(nfc_normalize(text), chr(8232), chr(10)), chr(8233), chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '</?[a-zA-Z][^<>\n]*>|<\|[a-z_]+\|>|&[a-z]{{2,6}};', ' ', 'g') AS t
  FROM documents WHERE regexp_matches(text, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]')),
line AS (SELECT doc_id, l FROM (SELECT doc_id, regexp_replace(unnest(string_split(t, chr(10))), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS l FROM seen) WHERE l <> ''),
per_line AS (SELECT doc_id, count(*) AS lines, sum(length(l)) AS total, avg(regexp_matches(l, '[.!?…。！？:;]["''”’»)\]]*$')::INT) AS punctuated FROM line GROUP BY 1),
again AS (SELECT doc_id, sum(length(l) * (k - 1)) AS twice FROM (SELECT doc_id, l, count(*) AS k FROM line GROUP BY ALL) GROUP BY 1),
word AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '{_WORD}+(?:[''’\-]{_WORD}+)*')) AS w FROM seen),
listed AS (SELECT DISTINCT lower(word) AS w, 1 AS hit FROM common_words WHERE word IS NOT NULL),
per_word AS (SELECT doc_id, count(*) AS words, avg(length(w)) AS mean, avg(coalesce(hit, 0)) AS common FROM word LEFT JOIN listed USING (w) GROUP BY 1),
dense AS (SELECT doc_id, regexp_replace(t, '[{_BLANK}]+', '', 'g') AS x FROM seen),
per_char AS (SELECT doc_id, greatest(1, length(x)) AS n, length(regexp_replace(x, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(x, '[^\p{{L}}\p{{Nl}}\p{{No}}]', '', 'g')) AS letters FROM dense)
SELECT doc_id, coalesce(words, 0) AS words, coalesce(lines, 0) AS lines, CASE WHEN n IS NOT NULL THEN round(coalesce(mean, 0), 9) END AS mean_word_length, round((n - letters - digits) / n, 9) AS symbol_ratio, round(punctuated, 9) AS punctuated_lines,
  CASE WHEN n IS NOT NULL THEN round(coalesce(common, 0), 9) END AS common_words, round(digits / n, 9) AS digit_ratio, round(twice / total, 9) AS duplicate_lines
FROM documents LEFT JOIN per_word USING (doc_id) LEFT JOIN per_line USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN per_char USING (doc_id)"""
ORACLES = {
    "p9_counts": _COUNTS,
    "p7_ids": f"{_BPE} SELECT doc_id, ids FROM coded",
    "p8_found": f"{_BPE} SELECT doc_id FROM coded WHERE len(ids) > {CAPACITY}",
    "p8_whole": f"{_BPE} SELECT doc_id, ceil(len(ids) / {CAPACITY})::BIGINT AS pieces, len(ids)::BIGINT AS tokens, true AS fits FROM coded WHERE len(ids) > 0",
    "p3_report": f"{_REACHABLE} SELECT category, is_safe::INTEGER AS is_safe, n AS eligible, size::BIGINT AS sample_size, permille * size / 1000.0::DOUBLE AS wanted, round(reachable, 3) AS reachable, round(greatest(0, permille * size / 1000.0::DOUBLE - reachable), 3) AS gap, (n < min_rows OR n * 1000 < permille * size)::INTEGER AS short FROM reached",
    "p3_taken": f"{_REACHABLE} SELECT category, is_safe::INTEGER AS is_safe, n AS eligible, true AS close, (SELECT round(sum(reachable))::BIGINT FROM reached) AS sample_rows FROM reached",
    "p4_daily": f"""WITH {_VALUES}
SELECT category, day, metric, (CASE WHEN value < 0 THEN -floor(log2(1 + abs(value)) * 64) - 1 ELSE floor(log2(1 + abs(value)) * 64) END)::INTEGER AS bucket, count(*) AS n, min(value) AS lo, max(value) AS hi FROM vals GROUP BY ALL""",
    "p6_whole": f"""
SELECT kind AS entity_kind, entity AS entity_key, count(*) AS rows, 1::BIGINT AS splits FROM (
  SELECT 'video' AS kind, {SQL_SQUEEZE.format("video_id")} AS entity FROM stages UNION ALL SELECT 'episode', episode_index::VARCHAR FROM lerobot_datasource) WHERE entity IS NOT NULL GROUP BY 1, 2""",
    "p2_found": f"{_RUNS} SELECT episode_index, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM numbered GROUP BY episode_index, run HAVING count(*) > 1",
    "p2_events": f"""{_RUNS}, stepped AS (SELECT *, lag(t IGNORE NULLS) OVER (PARTITION BY episode_index, run ORDER BY frame_index) AS before FROM numbered)
SELECT episode_index, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS frames,
  CASE WHEN count(t) > 1 THEN round(arg_max(t, frame_index) FILTER (t IS NOT NULL) - arg_min(t, frame_index) FILTER (t IS NOT NULL), 6) END AS duration_sec,
  count(*) FILTER (t < before) AS clock_steps_back
FROM stepped GROUP BY episode_index, run""",
    "p5_found": f"""
WITH {SQL_CURRENT}
SELECT vid AS video_id, clip_index FROM (
  SELECT vid, clip_index, row_number() OVER (PARTITION BY vid ORDER BY sharpness DESC, motion_score DESC NULLS LAST, clip_index) AS r
  FROM current_clips WHERE sharpness >= 0 AND NOT isnan(sharpness)) WHERE r <= 3""",
    "p3_found": f"""
WITH {SQL_CURRENT},
eligible AS (SELECT t.category, t.is_safe, count(c.vid) AS n, any_value(t.min_rows) AS min_rows, any_value(t.target_permille) AS permille
  FROM sample_targets t LEFT JOIN current_clips c ON {SQL_SQUEEZE.format("c.category")} = t.category AND c.is_safe = t.is_safe GROUP BY 1, 2),
sized AS (SELECT *, sum(n) OVER () // 10 AS size FROM eligible)
SELECT category, is_safe::INTEGER AS is_safe FROM sized WHERE n < min_rows OR n * 1000 < permille * size""",
    "p4_percentiles": f"""
WITH vals AS (
  SELECT {SQL_SQUEEZE.format("category")} AS category, m.metric, m.value FROM stages,
    LATERAL (SELECT unnest([{{'metric': 'brightness', 'value': CASE WHEN brightness >= 0 THEN brightness END}}, {{'metric': 'contrast', 'value': CASE WHEN contrast > 0 THEN contrast END}}, {{'metric': 'sharpness', 'value': CASE WHEN sharpness >= 0 THEN sharpness END}}], recursive := true)) m
  WHERE m.value IS NOT NULL AND NOT isnan(m.value)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category, metric ORDER BY value) AS r, count(*) OVER (PARTITION BY category, metric) AS total,
    CASE WHEN value < 0 THEN -floor(log2(1 + abs(value)) * 64) - 1 ELSE floor(log2(1 + abs(value)) * 64) END AS bucket FROM vals),
spans AS (SELECT *, min(value) OVER (PARTITION BY category, metric, bucket) AS lo, max(value) OVER (PARTITION BY category, metric, bucket) AS hi FROM ranked)
SELECT category, metric, p.permille::INTEGER AS permille, total, value, lo AS summary_low, hi AS summary_high
FROM spans, (SELECT unnest({PERMILLES}) AS permille) p WHERE r = greatest(1, (p.permille * total + 999) // 1000)""",
    "p4_by_day": f"""
WITH vals AS (
  SELECT {SQL_SQUEEZE.format("category")} AS category, d.day, m.metric, m.value FROM stages, LATERAL (SELECT processed_at::DATE AS day WHERE processed_at IS NOT NULL UNION ALL SELECT NULL) d,
    LATERAL (SELECT unnest([{{'metric': 'brightness', 'value': CASE WHEN brightness >= 0 THEN brightness END}}, {{'metric': 'contrast', 'value': CASE WHEN contrast > 0 THEN contrast END}}, {{'metric': 'sharpness', 'value': CASE WHEN sharpness >= 0 THEN sharpness END}}], recursive := true)) m
  WHERE m.value IS NOT NULL AND NOT isnan(m.value)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day, category, metric ORDER BY value) AS r, count(*) OVER (PARTITION BY day, category, metric) AS total,
    CASE WHEN value < 0 THEN -floor(log2(1 + abs(value)) * 64) - 1 ELSE floor(log2(1 + abs(value)) * 64) END AS bucket FROM vals),
spans AS (SELECT *, min(value) OVER (PARTITION BY day, category, metric, bucket) AS lo, max(value) OVER (PARTITION BY day, category, metric, bucket) AS hi FROM ranked)
SELECT day, category, metric, p.permille::INTEGER AS permille, total, value, lo AS summary_low, hi AS summary_high
FROM spans, (SELECT unnest({PERMILLES}) AS permille) p WHERE r = greatest(1, (p.permille * total + 999) // 1000)""",
    "p6_found": f"""
WITH draft AS (
  SELECT {SQL_SQUEEZE.format("entity_kind")} AS kind, record_id, regexp_replace({SQL_SQUEEZE.format("split_name")}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS x FROM split_draft),
named AS (
  SELECT kind, record_id, coalesce((SELECT any_value(t.split_name) FROM split_targets t WHERE starts_with(x, t.split_name) OR starts_with(t.split_name, x) HAVING count(*) = 1), x) AS split
  FROM draft WHERE x <> ''),
entity AS (
  SELECT 'video' AS kind, clip_row AS record_id, {SQL_SQUEEZE.format("video_id")} AS entity FROM stages
  UNION SELECT 'episode', "index", episode_index::VARCHAR FROM lerobot_datasource)
SELECT kind AS entity_kind, entity AS entity_key FROM named JOIN entity USING (kind, record_id) WHERE entity IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
