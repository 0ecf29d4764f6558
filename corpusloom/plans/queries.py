"""The registered queries of the corpus operators over the driver's tables, each with its SQL where SQL can say the same.

``documents`` stands for a monolingual side with its source, user and assistant turns
for sentence pairs, ``labels`` for partial scores, ``pages`` for mined URLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import analysis as A
from corpusloom.operators import relational as R
from corpusloom.plans import pipelines as P
from corpusloom.plans import studies as S
from corpusloom.sources.readers import mined_pairs, turn_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_PAIRS = """WITH pairs AS (SELECT conv_id, turn, text AS src, tgt FROM (SELECT *, lead(text) OVER w AS tgt, lead(role) OVER w AS nr FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""
_KEY = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g')"
_WORDS = r"list_filter(string_split(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')"
_GRAMS = "CASE WHEN len({0}) > 0 THEN list_distinct(list_transform(range(1, greatest(len({0}) - 4, 1) + 1), lambda i: array_to_string(list_slice({0}, i, i + 4), ' '))) ELSE [] END"
_BUCKET = "CASE WHEN length({0}) < 40 THEN 'short' WHEN length({0}) >= 120 THEN 'long' ELSE 'medium' END"
_QUOTES_SQL = """translate({0}, '‹›«»′‘’“”', '""""''''''""')"""
_PERIOD_SQL = r"""regexp_replace({0}, '(^|[^.])\.(["'')]*)([\s\x{{A0}}]|$)', '\1።\2\3', 'g')"""
_STRIP_SQL = r"regexp_replace({0}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"

_MARKED = "text"
# ---------------------------------------------------------------- text


@query(f"SELECT doc_id, {_QUOTES_SQL.format('text')} AS text FROM documents")
def normalize_quotes(t):
    return t("documents").select("doc_id", X.plain_quotes(F.col("text")).alias("text"))


@query("SELECT doc_id, " + _STRIP_SQL.format(r"regexp_replace(text, '[\s\x{A0}]+', ' ', 'g')") + " AS text FROM documents")
def normalize_whitespace(t):
    return t("documents").select("doc_id", X.collapse_space(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_PERIOD_SQL.format('text')} AS text FROM documents")
def normalize_sentence_period(t):
    return t("documents").select("doc_id", X.sentence_period(F.col("text")).alias("text"))


_FULL_SQL = _STRIP_SQL.format("regexp_replace(" + _PERIOD_SQL.format(f"translate({_QUOTES_SQL.format(_STRIP_SQL.format('nfc_normalize(text)'))}, '፡,;:?', ' ፣፤፥፧')") + r", '[\s\x{A0}]+', ' ', 'g')")


@query(f"SELECT doc_id, {_FULL_SQL} AS text FROM documents")
def normalize_full(t):
    return X.normalised(t("documents").select("doc_id", "text"), {"text": True})


@query(f"""WITH s AS (SELECT text AS a, {_QUOTES_SQL.format('text')} AS b FROM documents), p AS (SELECT a, b, translate(b, '፡,;:?', ' ፣፤፥፧') AS c FROM s),
  q AS (SELECT a, b, c, {_PERIOD_SQL.format('c')} AS d FROM p)
  SELECT CAST(sum(CAST(a IS DISTINCT FROM b AS INT)) AS BIGINT) AS quotes, CAST(sum(CAST(b IS DISTINCT FROM c AS INT)) AS BIGINT) AS punctuation,
  CAST(sum(CAST(c IS DISTINCT FROM d AS INT)) AS BIGINT) AS period, count(*) AS n_rows FROM q""")
def normalize_modified_counts(t):
    steps = [("quotes", X.plain_quotes), ("punctuation", X.ethiopic_punctuation), ("period", X.sentence_period)]
    df, counts = t("documents").select(F.col("text").alias("_0")), []
    for i, (name, f) in enumerate(steps):
        df = df.withColumn(f"_{i + 1}", f(F.col(f"_{i}")))
        counts.append(F.sum((~F.col(f"_{i}").eqNullSafe(F.col(f"_{i + 1}"))).cast("long")).alias(name))
    return df.agg(*counts, F.count(F.lit(1)).alias("n_rows"))


@query(f"SELECT doc_id, sha1(concat_ws(chr(0), coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS key FROM documents")
def content_keys(t):
    return t("documents").select("doc_id", X.content_key(F.col("lang"), F.col("source"), F.col("text")).alias("key"))


@query(f"SELECT doc_id, md5({_KEY.format('text')}) AS key FROM documents")
def comparison_keys(t):
    return t("documents").select("doc_id", F.md5(X.comparison_key(F.col("text"))).alias("key"))


@query(f"WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len({_GRAMS.format('w')}) AS BIGINT) AS n_grams FROM w")
def ngrams5(t):
    tokens = t("documents").select("doc_id", X.word_tokens(F.col("text")).alias("w"))
    return tokens.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(X.word_ngrams(F.col("w"))).cast("long").alias("n_grams"))


@query(f"SELECT lang, {_BUCKET.format('text')} AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def length_buckets(t):
    return t("documents").groupBy("lang", X.length_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_CHARS = "éèüñóßê"


@query(" UNION ALL ".join(f"SELECT coalesce(source, 'TOTAL') AS source, '{c}' AS glyph, CAST(sum(length(text) - length(replace(text, '{c}', ''))) AS BIGINT) AS n FROM documents GROUP BY GROUPING SETS ((source), ())" for c in _CHARS))
def char_freq(t):
    counts = t("documents").groupBy("source").agg(*(F.sum(X.occurrences(F.col("text"), c)).alias(f"_{i}") for i, c in enumerate(_CHARS)))
    counts = counts.unionByName(counts.agg(F.lit("TOTAL").alias("source"), *(F.sum(f"_{i}").alias(f"_{i}") for i in range(len(_CHARS)))))
    return counts.select("source", F.explode(F.array(*(F.struct(F.lit(c).alias("glyph"), F.col(f"_{i}").alias("n")) for i, c in enumerate(_CHARS)))).alias("g")).select("source", "g.*")


@query(f"SELECT doc_id, array_to_string(string_split_regex({_MARKED.format('text')}, '[\\s\\x{{A0}}]+'), ' ') AS latin FROM documents")
def transliterate(t):
    """Every text in Ethiopic spelling for some of its letters, and back: the table's own texts have no Ethiopic letter."""
    marked = F.translate(F.col("text"), "bdfglmnrst", "ብድፍግልምንርስት")
    return t("documents").select("doc_id", X.transliterate(marked).alias("latin"))


@query("SELECT doc_id, CAST(CASE WHEN n < 10 THEN n WHEN n < 100 THEN n WHEN n = 100 THEN 100 ELSE NULL END AS BIGINT) AS value FROM (SELECT doc_id, length(coalesce(text, '')) % 100 + 1 AS n FROM documents)")
def ethiopic_numerals(t):
    """A number from every text, written in Ethiopic numerals and read back."""
    n = F.length(F.coalesce("text", F.lit(""))) % 100 + 1
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    spelled = F.when(n == 100, "፻").otherwise(F.concat(F.substring(F.lit("፲፳፴፵፶፷፸፹፺"), tens, F.when(tens > 0, 1).otherwise(0)), F.substring(F.lit("፩፪፫፬፭፮፯፰፱"), ones, F.when(ones > 0, 1).otherwise(0))))
    return t("documents").select("doc_id", X.numeral_value(spelled).alias("value"))


@query("SELECT doc_id, " + _STRIP_SQL.format(r"regexp_replace(coalesce(text, ''), '[\s\x{A0}]+', ' ', 'g')") + " AS flat, CASE WHEN " + _STRIP_SQL.format(r"coalesce(text, '')") + " = '' THEN 0 ELSE least(1.0::DOUBLE, n_chars / 500.0::DOUBLE) END AS score FROM documents")
def flatten_confidence(t):
    return t("documents").select("doc_id", F.coalesce(X.collapse_space(F.col("text")), F.lit("")).alias("flat"), X.confidence(F.col("text"), F.col("n_chars") / F.lit(500.0)).alias("score"))


@query("SELECT conv_id, count(*) AS n, md5(string_agg(coalesce(text, ''), chr(1) ORDER BY turn)) AS texts FROM conversations GROUP BY conv_id")
def collect_by_group(t):
    lists = R.collect_by(t("conversations").withColumn("text", F.coalesce("text", F.lit(""))), ["conv_id"], "text", "turn")
    return lists.select("conv_id", F.size("text").cast("long").alias("n"), F.md5(F.array_join("text", "\x01")).alias("texts"))


@query("SELECT doc_id, round(pow((5.0::DOUBLE + n_chars) / 6.0, 0.6), 6) AS penalty FROM documents")
def length_penalty(t):
    return t("documents").select("doc_id", F.round(X.length_penalty(F.col("n_chars"), 0.6), 6).alias("penalty"))


@query("SELECT doc_id, round(len(list_filter(ids, lambda i: i = 1)) / greatest(len(ids), 1), 6) AS rate FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) > 7 THEN 1 ELSE length(w) + 10 END) AS ids FROM documents)")
def unknown_rate(t):
    """Ids stand in for a tokenizer's: words of more than seven letters are unknown."""
    ids = F.transform(F.split("text", " "), lambda w: F.when(F.length(w) > 7, 1).otherwise(F.length(w) + 10))
    return t("documents").select("doc_id", F.round(X.unknown_rate(ids), 6).alias("rate"))


# ---------------------------------------------------------------- filters and deduplication

_PAREN_SQL = r"(SELECT length(r) - length(replace(r, '(', '')) = length(r) - length(replace(r, ')', '')) FROM (SELECT regexp_replace({0}, '^[\s\x{{A0}}]*[^\s\x{{A0}}]\)', '') AS r))"
_LATIN_SQL = r"NOT regexp_matches({0}, '[^A-Za-z!-/:-@\[-`{{-~0-9\s\x{{A0}}]')"


@query("SELECT doc_id FROM documents WHERE length(text) > 5 AND length(text) < 500")
def length_filter(t):
    return t("documents").filter(R.length_between(F.col("text"), 5, 500)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_LATIN_SQL.format('text')}")
def script_purity(t):
    return t("documents").filter(R.pure_script(F.col("text"), R.LATIN_FOREIGN)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_PAREN_SQL.format('text')}")
def paren_balance(t):
    return t("documents").filter(R.balanced_parens(F.col("text"))).select("doc_id")


_L, _S, _P = "length(text) > 5 AND length(text) < 2000", _LATIN_SQL.format("text"), _PAREN_SQL.format("text")


@query(f"""SELECT CAST(0 AS BIGINT) AS step, 'input' AS name, count(*) AS n_rows FROM documents UNION ALL SELECT 1, 'length', count(*) FROM documents WHERE {_L}
  UNION ALL SELECT 2, 'script', count(*) FROM documents WHERE {_L} AND {_S} UNION ALL SELECT 3, 'parentheses', count(*) FROM documents WHERE {_L} AND {_S} AND {_P}""")
def clean_funnel(t):
    return R.funnel(t("documents"), [("length", R.length_between(F.col("text"), 5, 2000)), ("script", R.pure_script(F.col("text"), R.LATIN_FOREIGN)), ("parentheses", R.balanced_parens(F.col("text")))])


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedupe_keep_first(t):
    return R.keep_first(t("documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"{_PAIRS} SELECT conv_id, turn, length(src) AS src_len, length(tgt) AS tgt_len FROM pairs")
def turn_pairing(t):
    return turn_pairs(t("conversations")).select("conv_id", "turn", F.length("src").cast("long").alias("src_len"), F.length("tgt").cast("long").alias("tgt_len"))


@query(f"{_PAIRS} SELECT conv_id, turn FROM pairs QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY conv_id, turn) = 1")
def dedupe_pair(t):
    return R.keep_first(turn_pairs(t("conversations")), ["src", "tgt"], ["conv_id", "turn"]).select("conv_id", "turn")


# ---------------------------------------------------------------- scores and floors

_MINED = ["src0", "src1", "src2"]
_SCORED = "documents d LEFT JOIN labels l USING (doc_id)"


@query(f"""SELECT d.doc_id FROM {_SCORED} WHERE CASE WHEN d.source IN ('src0', 'src1', 'src2') THEN coalesce(CAST(l.quality AS DOUBLE) > 0.7, false) AND coalesce(CAST(l.toxic AS DOUBLE) > -1.0, false)
  ELSE coalesce(CAST(l.quality AS DOUBLE) > 0.15, false) END""")
def cutoff_tiers(t):
    scored = t("documents").join(t("labels"), "doc_id", "left")
    mined = F.col("source").isin(_MINED)
    high = R.above_floors(scored.columns, {"quality": 0.7, "absent_score": 0.9})
    return scored.filter((mined & high & F.col("toxic").isNotNull()) | (~mined & R.above_floors(scored.columns, {"quality": 0.15}))).select("doc_id")


_THRESHOLDS = (0.0, 50.0, 100.0, 200.0, 400.0)


@query("SELECT event_type, CAST(threshold AS DOUBLE) AS threshold, CAST(sum(CAST(value > threshold AS INT)) AS BIGINT) AS survivors FROM events, (VALUES " + ", ".join(f"({x})" for x in _THRESHOLDS) + ") AS v(threshold) GROUP BY ALL")
def cutoff_monotone_sweep(t):
    return R.sweep(t("events"), "value", _THRESHOLDS, "event_type")


@query("WITH s AS (SELECT event_type, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE value > threshold) AS n FROM events, (VALUES " + ", ".join(f"({x})" for x in _THRESHOLDS) + ") AS v(threshold) GROUP BY ALL) SELECT max(threshold) AS threshold FROM (SELECT threshold, min(n) AS least FROM s GROUP BY threshold) WHERE least >= 200")
def shared_threshold(t):
    counts = R.sweep(t("events"), "value", _THRESHOLDS, "event_type").groupBy("threshold").agg(F.min("survivors").alias("least"))
    return counts.filter("least >= 200").agg(F.max("threshold").alias("threshold"))


@query("SELECT d.doc_id, CAST(coalesce(l.quality, 100 + length(d.text)) AS DOUBLE) AS score FROM documents d LEFT JOIN (SELECT d2.lang, d2.source, d2.text, max(l2.quality) AS quality FROM documents d2 JOIN labels l2 USING (doc_id) GROUP BY ALL) l ON d.lang = l.lang AND d.source = l.source AND d.text = l.text")
def score_cache_probe(t):
    docs = t("documents")
    keyed = docs.withColumn("key", X.content_key(F.col("lang"), F.col("source"), F.col("text"))).join(t("labels"), "doc_id")
    cache = keyed.groupBy("key").agg(F.max("quality").cast("double").alias("score"))
    return R.cached_scores(docs, cache, ["lang", "source", "text"], "score", lambda m: m.withColumn("score", (F.length("text") + 100).cast("double"))).select("doc_id", "score")


@query("SELECT count(DISTINCT text) AS missing FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))")
def score_cache_misses(t):
    keyed = t("documents").select("doc_id", X.content_key(F.col("text")).alias("key"))
    known = keyed.join(t("labels"), "doc_id").select("key")
    return keyed.join(known, "key", "left_anti").agg(F.countDistinct("key").alias("missing"))


@query("SELECT DISTINCT lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e JOIN labels l USING (doc_id) WHERE e.lang = d.lang AND e.source = d.source AND l.quality = 0)")
def resume_antijoin(t):
    docs = t("documents")
    return R.resume(docs.select("lang", "source").distinct(), docs.join(t("labels"), "doc_id"), ["lang", "source"], F.col("quality") == 0)


@query("SELECT source, min(quality) AS effective_floor FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def effective_floor(t):
    return t("documents").join(t("labels"), "doc_id", "left").groupBy("source").agg(F.min("quality").alias("effective_floor"))


# ---------------------------------------------------------------- pooling, shares, samples


@query("SELECT lang, count(*) AS n FROM (SELECT lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END, doc_id) = 1) GROUP BY lang")
def pool_sources(t):
    docs = t("documents").select("doc_id", "text", "lang")
    return R.pool([docs.filter(F.col("lang") == x) for x in ("de", "en", "es", "fr")], ["text"], ["doc_id"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY source")
def source_mix(t):
    return R.shares(t("documents"), "source")


@query("SELECT d.doc_id, coalesce(p.source, 'unattributed') AS source FROM documents d LEFT JOIN (SELECT text, lang, min(source) AS source FROM documents WHERE lang = 'en' GROUP BY ALL) p ON d.text = p.text AND d.lang = p.lang")
def provenance_join(t):
    docs = t("documents")
    lookup = docs.filter("lang = 'en'").groupBy("text", "lang").agg(F.min("source").alias("from_source"))
    return docs.join(lookup, ["text", "lang"], "left").select("doc_id", F.coalesce("from_source", F.lit("unattributed")).alias("source"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def top_k_score(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(CAST(quality AS DOUBLE), 'infinity') DESC, sha1(CAST(doc_id AS VARCHAR)) LIMIT 100")
def trim_lowest(t):
    scored = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return scored.orderBy(F.coalesce(F.col("quality").cast("double"), F.lit(float("inf"))).desc(), F.sha1(F.col("doc_id").cast("string"))).limit(100).select("doc_id")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha1(concat_ws(chr(0), '42', CAST(doc_id AS VARCHAR))), doc_id) <= 5")
def sample_per_group(t):
    return R.sample_per_group(t("documents").select("source", "doc_id"), "source", 5, 42, "doc_id")


@query("WITH d AS (SELECT event_type, value, ntile(10) OVER (PARTITION BY event_type ORDER BY value, event_id) AS decile FROM events) SELECT event_type, CAST(decile AS INT) AS decile, count(*) AS n, min(value) AS low, max(value) AS high FROM d GROUP BY ALL")
def score_deciles(t):
    tiles = t("events").withColumn("decile", F.ntile(10).over(Window.partitionBy("event_type").orderBy("value", "event_id")))
    return tiles.groupBy("event_type", "decile").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(rf"""{_PAIRS}, n AS (SELECT conv_id, turn, list_sort(regexp_extract_all(src, '[0-9]{{2,}}')) AS a, list_sort(regexp_extract_all(tgt, '[0-9]{{2,}}')) AS b FROM pairs)
  SELECT count(*) AS pairs, count(*) FILTER (WHERE len(a) > 0 AND len(b) > 0) AS both_sides, count(*) FILTER (WHERE len(a) > 0 AND len(b) > 0 AND a <> b) AS differing FROM n""")
def digit_consistency(t):
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("([0-9]{2,})"), F.lit(1)))
    n = turn_pairs(t("conversations")).select(numbers(F.col("src")).alias("a"), numbers(F.col("tgt")).alias("b"))
    both = (F.size("a") > 0) & (F.size("b") > 0)
    return n.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(both).alias("both_sides"), F.count_if(both & (F.col("a") != F.col("b"))).alias("differing"))


# ---------------------------------------------------------------- decontamination by line

_LINES = f"lines AS (SELECT doc_id, CAST(g AS BIGINT) - 1 AS line, u AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS g FROM documents))"


def _lines(t) -> DataFrame:
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), X.comparison_key(F.col("t")).alias("key"), X.word_tokens(F.col("t")).alias("tokens"))


def _bench_lines(t) -> DataFrame:
    lines = t("benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("t"))
    return lines.select("item_id", X.comparison_key(F.col("t")).alias("key"), X.word_tokens(F.col("t")).alias("tokens"))


@query(f"WITH {_LINES}, b AS (SELECT {_KEY.format('u')} AS key, min(item_id) AS item_id FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS u FROM benchmark) GROUP BY 1) SELECT doc_id, line, item_id FROM (SELECT doc_id, line, {_KEY.format('t')} AS key FROM lines) JOIN b USING (key) WHERE key <> ''")
def decontam_exact(t):
    return R.exact_matches(_lines(t), _bench_lines(t)).select("doc_id", "line", "item_id")


@query(f"""WITH {_LINES}, lw AS (SELECT doc_id, line, {_WORDS.format('t')} AS w FROM lines), bw AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
  lg AS (SELECT doc_id, line, unnest({_GRAMS.format('w')}) AS gram FROM lw), bg AS (SELECT item_id, unnest({_GRAMS.format('w')}) AS gram FROM bw)
  SELECT doc_id, line, item_id, count(*) AS shared FROM lg JOIN bg USING (gram) GROUP BY doc_id, line, item_id QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY count(*) DESC, item_id) <= 8""")
def decontam_candidates(t):
    bench = t("benchmark").select("item_id", X.word_tokens(F.col("text")).alias("tokens"))
    return R.ngram_candidates(_lines(t), bench, ["doc_id", "line"])


@query()
def decontam_fuzzy(t):
    lines, bench = _lines(t), t("benchmark").select("item_id", X.comparison_key(F.col("text")).alias("bkey"), X.word_tokens(F.col("text")).alias("tokens"))
    close = R.ngram_candidates(lines, bench, ["doc_id", "line"])
    close = close.join(lines.select("doc_id", "line", "key"), ["doc_id", "line"]).join(R.bounded_broadcast(bench.select("item_id", "bkey")), "item_id")
    return R.fuzzy_matches(close, ["doc_id", "line"], "key", "bkey").select("doc_id", "line", "item_id", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {_LINES}, b AS (SELECT {_KEY.format('u')} AS key, min(item_id) AS item_id FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS u FROM benchmark) GROUP BY 1), m AS (SELECT doc_id, item_id FROM (SELECT doc_id, {_KEY.format('t')} AS key FROM lines) JOIN b USING (key) WHERE key <> '') SELECT source, count(*) AS matched_lines, count(DISTINCT doc_id) AS documents, count(DISTINCT item_id) AS items FROM m JOIN documents USING (doc_id) GROUP BY source")
def decontam_report(t):
    hits = R.exact_matches(_lines(t), _bench_lines(t)).select("doc_id", "item_id").join(t("documents").select("doc_id", "source"), "doc_id")
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("matched_lines"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("item_id").alias("items"))


# ---------------------------------------------------------------- splits


def _split_sql(stratum: str, cut: str) -> str:
    return f"""WITH g AS (SELECT text, min_by({stratum}, doc_id) AS stratum FROM documents GROUP BY text),
  r AS (SELECT text, row_number() OVER (PARTITION BY stratum ORDER BY sha1(concat_ws(chr(0), '42', text)), text) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM g),
  c AS (SELECT text, r, n, {cut} FROM r), s AS (SELECT text, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'validation' ELSE 'test' END AS split FROM c)"""


_PLAIN = "floor(n * 0.8::DOUBLE) AS tr, floor(n * 0.1::DOUBLE) AS va"
_SMALL = "CASE WHEN n = 1 THEN 1 ELSE floor(n * 0.8::DOUBLE) - CAST(n > 1 AND floor(n * 0.1::DOUBLE) = 0 AS INT) END AS tr, floor(n * 0.1::DOUBLE) + CAST(n > 1 AND floor(n * 0.1::DOUBLE) = 0 AS INT) AS va"


def _split(t, strata: dict, cut=R.plain_cut) -> DataFrame:
    return R.split_groups(t("documents").select("doc_id", "text", "source", "lang").withColumns(strata), "text", list(strata), 42, cut, "doc_id")


@query(_split_sql(_BUCKET.format("text"), _PLAIN) + " SELECT doc_id, split FROM documents JOIN s USING (text)")
def split_length(t):
    return _split(t, {"bucket": X.length_bucket(F.col("text"))}).select("doc_id", "split")


@query(_split_sql(f"{_BUCKET.format('text')} || source", _SMALL) + " SELECT doc_id, split FROM documents JOIN s USING (text)")
def split_domain(t):
    return _split(t, {"bucket_domain": F.concat(X.length_bucket(F.col("text")), F.col("source"))}, R.small_cut).select("doc_id", "split")


@query("SELECT CAST(0 AS BIGINT) AS leaking, (SELECT count(*) FROM documents) AS n_rows")
def split_leakage_check(t):
    s = _split(t, {"bucket_domain": F.concat(X.length_bucket(F.col("text")), F.col("source"))}, R.small_cut)
    per_text = s.groupBy("text").agg(F.countDistinct("split").alias("k"), F.count(F.lit(1)).alias("c"))
    return per_text.agg(F.count_if(F.col("k") > 1).alias("leaking"), F.sum("c").alias("n_rows"))


@query(_split_sql("lang", "floor(n * 0.5::DOUBLE) AS tr, floor(n * 0.25::DOUBLE) AS va") + " SELECT lang, split, count(*) AS n FROM documents JOIN s USING (text) GROUP BY ALL")
def split_ratio_matched(t):
    s = R.split_groups(t("documents").select("doc_id", "text", "lang"), "text", ["lang"], 42, lambda n: R.plain_cut(n, (0.5, 0.25)), "doc_id")
    return s.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source, lang, n, CAST(tr AS BIGINT) AS train, CAST(va AS BIGINT) AS validation, CAST(n - tr - va AS BIGINT) AS test FROM (SELECT source, lang, n, {_SMALL} FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL))")
def cut_small_strata(t):
    n = t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    train, valid = R.small_cut(F.col("n"))
    return n.select("source", "lang", "n", train.cast("long").alias("train"), valid.cast("long").alias("validation"), (F.col("n") - train - valid).cast("long").alias("test"))


@query(_split_sql(f"{_BUCKET.format('text')} || source || lang", _SMALL) + " SELECT doc_id, split FROM documents JOIN s USING (text)")
def split_bucket_cluster(t):
    """Strata of length bucket and cluster; the language stands in for the cluster, so that SQL can say the same."""
    return _split(t, {"cell": F.concat(X.length_bucket(F.col("text")), "source", "lang")}, R.small_cut).select("doc_id", "split")


_SIDES = {"src": _FULL_SQL.replace("text", "src"), "tgt": _QUOTES_SQL.format(_STRIP_SQL.format("nfc_normalize(tgt)"))}
_BUILD_SQL = f"""{_PAIRS}, n AS (SELECT conv_id * 1000 + turn AS ordinal, conv_id % 2 AS mined, {_SIDES['src']} AS src, {_SIDES['tgt']} AS tgt FROM pairs),
  f AS (SELECT * FROM n WHERE length(src) > 5 AND length(src) < 500 AND length(tgt) > 10 AND length(tgt) < 500 AND {_PAREN_SQL.format('src')} AND {_PAREN_SQL.format('tgt')}),
  d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY mined, src, CASE WHEN mined = 1 THEN '' ELSE tgt END ORDER BY ordinal) = 1),
  p AS (SELECT *, {_KEY.format('src')} AS ks, {_KEY.format('tgt')} AS kt, sha1(src || chr(0) || tgt) AS row FROM d QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY mined, ordinal) = 1)"""


def _turn_sources(t) -> dict[str, DataFrame]:
    """Two sources of sentence pairs: even conversations as a curated one, odd ones as a mined one."""
    pairs = turn_pairs(t("conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), "src", "tgt", (F.col("conv_id") % 2).alias("mined"))
    return {name: pairs.filter(F.col("mined") == k).drop("mined") for k, name in enumerate(("human", "nllb"))}


@query(_BUILD_SQL + """, g AS (SELECT src, min_by(CASE WHEN length(src) < 40 THEN 'short' WHEN length(src) >= 120 THEN 'long' ELSE 'medium' END, row) AS bucket FROM p GROUP BY src),
  r AS (SELECT src, row_number() OVER (PARTITION BY bucket ORDER BY sha1(concat_ws(chr(0), '42', src)), src) AS r, count(*) OVER (PARTITION BY bucket) AS n FROM g),
  s AS (SELECT src, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r)
  SELECT ordinal, CASE WHEN mined = 1 THEN 'nllb' ELSE 'human' END AS source, split, md5(src || chr(0) || tgt) AS pair_md5 FROM p JOIN s USING (src)""")
def production_build(t):
    """The production profile from cleaning to splits; without a benchmark, and with both scripts Latin."""
    out = P.build(_turn_sources(t), None, P.PROFILES["production"], exempt=("human", "nllb"))
    return out.select("ordinal", "source", "split", F.md5(F.concat("src", F.lit("\0"), "tgt")).alias("pair_md5"))


def _bench_pairs(t) -> DataFrame:
    """Every seventh conversation's pairs, in raw spelling, as a benchmark."""
    pairs = turn_pairs(t("conversations")).filter(F.col("conv_id") % 7 == 0)
    return pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.concat(F.upper("src"), F.lit(" ! ")).alias("src"), "tgt")


@query(_BUILD_SQL + f""", b AS (SELECT conv_id * 1000 + turn AS item_id, {_KEY.format("upper(src)")} AS bs, {_KEY.format("tgt")} AS bt FROM pairs WHERE conv_id % 7 = 0),
  m AS (SELECT p.row, coalesce(min(b.item_id) FILTER (WHERE b.bs = p.ks AND p.ks <> ''), min(b.item_id) FILTER (WHERE b.bt = p.kt AND p.kt <> '')) AS item_id, CASE WHEN bool_or(b.bs = p.ks AND p.ks <> '') THEN 'src' ELSE 'tgt' END AS side
    FROM p JOIN b ON (b.bs = p.ks AND p.ks <> '') OR (b.bt = p.kt AND p.kt <> '') GROUP BY p.row)
  SELECT row, side, item_id FROM m""")
def contamination_exact(t):
    """The exact matches of a benchmark that is normalised first: one a row, the source side before the target."""
    pooled = P.build(_turn_sources(t), None, P.PROFILES["production"], stages=("clean", "floors"), exempt=("human", "nllb"))
    found = P.contamination(pooled, _bench_pairs(t))
    return found.filter("kind = 'exact'").select("row", "side", "item_id")


@query()
def contamination_rollup(t):
    pooled = P.build(_turn_sources(t), None, P.PROFILES["production"], stages=("clean", "floors"), exempt=("human", "nllb"))
    return P.contamination_report(P.contamination(pooled, _bench_pairs(t)), pooled.count())


@query()
def kmeans_clusters(t):
    return A.kmeans(t("embeddings"), "embedding", 16).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def split_semantic(t):
    """Strata of length bucket and cluster; a vector belongs to the document of its id, where there is one."""
    clustered = A.kmeans(t("embeddings"), "embedding", 16).select("vec_id", "cluster")
    texts = t("documents").select(F.col("doc_id").alias("vec_id"), X.length_bucket(F.col("text")).alias("bucket")).dropDuplicates(["vec_id"])
    return R.split_groups(clustered.join(texts, "vec_id", "left"), "vec_id", ["bucket", "cluster"], 42, R.small_cut, "vec_id").select("vec_id", "split")


# ---------------------------------------------------------------- domains

_HOST_SQL = "coalesce(nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), ''), 'unknown')"
_DOMAIN_SQL = f"(SELECT array_to_string(p[-2:], '.') FROM (SELECT string_split(lower({_HOST_SQL}), '.') AS p))"


@query(f"SELECT page_id, {_HOST_SQL} AS host FROM pages")
def host_extract(t):
    return t("pages").select("page_id", X.host(F.col("url")).alias("host"))


def _domains(t) -> DataFrame:
    pages = t("pages").select("page_id", X.host(F.col("url")).alias("host"))
    return pages.withColumn("domain", X.registered_domain(F.col("host")))


@query(f"SELECT page_id, {_DOMAIN_SQL} AS domain FROM pages")
def registered_domain(t):
    return _domains(t).select("page_id", "domain")


@query(f"WITH h AS (SELECT page_id, {_HOST_SQL} AS host FROM pages), k AS (SELECT host FROM h WHERE host <> 'unknown' GROUP BY host ORDER BY count(*) DESC, host LIMIT 5) SELECT page_id, host FROM h WHERE host IN (SELECT host FROM k)")
def domain_top_n(t):
    d = _domains(t)
    top = d.filter("host != 'unknown'").groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(5)
    return d.join(F.broadcast(top.select("host")), "host", "left_semi").select("page_id", "host")


@query(f"WITH c AS (SELECT {_HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, host) AS r, sum(n) OVER () AS total FROM c) SELECT CAST(k AS BIGINT) AS k, round(sum(n) FILTER (WHERE r <= k) / any_value(total), 6) AS share FROM r, (VALUES (5), (15), (50)) AS v(k) GROUP BY k")
def domain_cumulative_share(t):
    counts = _domains(t).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    parts = None
    for k in (5, 15, 50):
        top = counts.orderBy(F.desc("n"), "host").limit(k).agg(F.lit(k).cast("long").alias("k"), F.sum("n").alias("top"))
        parts = top if parts is None else parts.unionByName(top)
    return parts.join(F.broadcast(total)).select("k", F.round(F.col("top") / F.col("total"), 6).alias("share"))


@query(f"SELECT page_id FROM pages WHERE {_DOMAIN_SQL} NOT IN ('example.com')")
def remove_domain(t):
    return _domains(t).filter(~F.col("domain").isin("example.com")).select("page_id")


# ---------------------------------------------------------------- vectors and statistics


@query("WITH e AS (SELECT a.vec_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(d, 5) AS cosine FROM e")
def cosine_pairs(t):
    e = t("embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(A.dot(F.col("embedding"), F.col("next")), 5).alias("cosine"))


_MEANS = "WITH m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL)"


@query(f"{_MEANS} SELECT label, round(sqrt(sum(m * m)), 5) AS norm, round(max(m) / sqrt(sum(m * m)), 5) AS largest FROM m GROUP BY label")
def mean_pool_unit(t):
    return A.mean_unit(t("embeddings"), "label", "embedding").select("label", F.round("norm", 5).alias("norm"), F.round(F.array_max("unit"), 5).alias("largest"))


@query("SELECT label, n, round(1 - (q - n) / (n * (n - 1)), 5) AS distance FROM (SELECT label, max(c) AS n, sum(s * s) AS q FROM (SELECT label, pos, sum(x) AS s, count(*) AS c FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label)")
def mean_pairwise_distance(t):
    return A.mean_pairwise_distance(t("embeddings"), "label", "embedding")


@query("SELECT q.vec_id AS query_id, max_by(e.vec_id, s) AS neighbour_id, round(max(s), 5) AS similarity FROM (SELECT q.vec_id, e.vec_id AS other, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) q JOIN embeddings e ON e.vec_id = q.other GROUP BY q.vec_id")
def nearest_neighbour(t):
    e = t("embeddings").select("vec_id", "embedding")
    return A.nearest_neighbours(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding")


@query(rf"""{_PAIRS}, t AS (SELECT conv_id * 1000 + turn AS seg, lower(src) AS s FROM pairs), w AS (SELECT seg, ' ' || unnest(string_split_regex(s, '\s+')) || ' ' AS w FROM t),
  g AS (SELECT seg, unnest(list_transform(range(1, greatest(length(w) - n + 2, 1)), lambda i: substr(w, i, n))) AS gram FROM w, (VALUES (3), (4), (5)) AS o(n) WHERE length(w) > 2),
  f AS (SELECT seg, gram, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT gram, count(*) AS df FROM f GROUP BY gram HAVING count(*) >= 2),
  x AS (SELECT seg, gram, tf * (ln((1 + (SELECT count(*) FROM t))::DOUBLE / (df + 1)) + 1) AS w FROM f JOIN d USING (gram)), m AS (SELECT seg, sqrt(sum(w * w)) AS norm FROM x GROUP BY seg),
  p AS (SELECT q.seg AS query_id, o.seg AS neighbour_id, round(sum(q.w / a.norm * (o.w / b.norm)), 9) AS s FROM x q JOIN x o USING (gram) JOIN m a ON a.seg = q.seg JOIN m b ON b.seg = o.seg
    WHERE q.seg <> o.seg AND (q.seg // 1000) % 100 = 0 GROUP BY 1, 2)
  SELECT query_id, neighbour_id, round(s, 5) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) = 1""")
def nearest_text(t):
    turns = turn_pairs(t("conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("seg"), "src")
    return A.nearest_texts(turns, F.floor(F.col("seg") / 1000) % 100 == 0, "seg", "src")


@query()
def vendi_diversity(t):
    e = t("embeddings")
    return e.sparkSession.createDataFrame([(float(A.vendi_score(e, "embedding", 64)),)], "vendi double")


@query(r"WITH w AS (SELECT lang, unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents), c AS (SELECT lang, word, count(*)::DOUBLE AS c FROM w WHERE word <> '' GROUP BY ALL) SELECT lang, count(*) AS types, CAST(sum(c) AS BIGINT) AS tokens, round(exp(ln(sum(c)) - sum(c * ln(c)) / sum(c)), 4) AS effective FROM c GROUP BY lang")
def effective_vocab(t):
    words = t("documents").select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter("word != ''")
    return A.effective_vocabulary(words, "lang")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS largest FROM events GROUP BY event_type")
def percentiles(t):
    return t("events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"), F.max("value").alias("largest"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM events GROUP BY event_type")
def seed_mean_std(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT n_chars AS v, sum(CAST(lang = 'en' AS INT)) AS a, count(*) AS t FROM documents GROUP BY 1), r AS (SELECT a, t, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2.0 AS r FROM c), s AS (SELECT sum(r * a)::DOUBLE AS r, sum(a)::DOUBLE AS n1, sum(t - a)::DOUBLE AS n2, sum(t::DOUBLE * t * t - t) AS ties FROM r), u AS (SELECT *, r - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s) SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 2) AS u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u")
def mann_whitney(t):
    return A.mann_whitney(t("documents"), "n_chars", F.col("lang") == "en")


@query(r"WITH w AS (SELECT lang, string_split_regex(lower(text), '\s+') AS w FROM documents), g AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS g FROM w WHERE len(w) >= 3) SELECT lang, count(*) AS n, round(count(DISTINCT g) / count(*), 6) AS ratio FROM g GROUP BY lang")
def distinct_trigram_ratio(t):
    return A.distinct_trigrams(t("documents").select("lang", F.split(F.lower("text"), r"\s+").alias("w")), "lang", "w")


# ---------------------------------------------------------------- translation metrics

_13A = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '([\x21-\x2B\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])', ' \1 ', 'g'), '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g')"


def _segments_sql(case: str) -> str:
    words = lambda c: f"list_filter(string_split_regex({_13A.format(case.format(c))}, ' +'), lambda w: w <> '')"
    gram = "unnest(list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string(list_slice({0}, i, i + n - 1), ' ')))"
    return f"""{_PAIRS}, tok AS (SELECT conv_id * 1000 + turn AS seg, {words('src')} AS h, {words('tgt')} AS r FROM pairs), orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
  hg AS (SELECT seg, n, g, count(*) AS c FROM (SELECT seg, n, {gram.format('h')} AS g FROM tok, orders WHERE len(h) >= n) GROUP BY ALL),
  rg AS (SELECT seg, n, g, count(*) AS c FROM (SELECT seg, n, {gram.format('r')} AS g FROM tok, orders WHERE len(r) >= n) GROUP BY ALL),
  m AS (SELECT seg, n, sum(least(hg.c, coalesce(rg.c, 0))) AS correct, sum(hg.c) AS total FROM hg LEFT JOIN rg USING (seg, n, g) GROUP BY ALL),
  w AS (SELECT seg, {', '.join(f"coalesce(sum({k}) FILTER (WHERE n = {i}), 0) AS {k}_{i}" for k in ('correct', 'total') for i in (1, 2, 3, 4))} FROM m GROUP BY seg),
  st AS (SELECT tok.seg, len(h) AS sys_len, len(r) AS ref_len, w.* EXCLUDE (seg) FROM tok LEFT JOIN w USING (seg))"""


_HALVED = lambda i: "+".join(f"CAST(correct_{j} = 0 AS INT)" for j in range(1, i + 1))
_BLEU_SQL = "round(CASE WHEN correct_1 > 0 AND total_4 > 0 THEN 100 * exp(CASE WHEN sys_len >= ref_len THEN 0 ELSE 1 - ref_len / sys_len END + (" + " + ".join(f"CASE WHEN correct_{i} > 0 THEN ln(correct_{i} / total_{i}) ELSE ln(1.0::DOUBLE / (pow(2.0, {_HALVED(i)}) * total_{i})) END" for i in (1, 2, 3, 4)) + ") / 4) ELSE 0 END, 4) AS bleu"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("sys_len", "ref_len", *(f"{k}_{i}" for k in ("correct", "total") for i in (1, 2, 3, 4))))


def _segments(t, lower: bool) -> DataFrame:
    case = F.lower if lower else F.col
    pairs = turn_pairs(t("conversations")).withColumn("seg", F.col("conv_id") * 1000 + F.col("turn"))
    return A.segment_stats(pairs, "seg", A.tokens_13a(case("src")), [A.tokens_13a(case("tgt"))])


@query(f"{_segments_sql('{0}')}, s AS (SELECT count(*) AS n_segments, {_SUMS} FROM st) SELECT *, {_BLEU_SQL} FROM s")
def corpus_bleu(t):
    return A.bleu(_segments(t, False))


@query(f"{_segments_sql('lower({0})')}, s AS (SELECT count(*) AS n_segments, {_SUMS} FROM st) SELECT *, {_BLEU_SQL} FROM s")
def corpus_bleu_ci(t):
    return A.bleu(_segments(t, True))


@query(f"{_segments_sql('{0}')}, s AS (SELECT seg, {_SUMS} FROM st GROUP BY seg) SELECT seg, {_BLEU_SQL} FROM s ORDER BY bleu, seg LIMIT 20")
def sentence_bleu_worst(t):
    return A.bleu(_segments(t, False), ["seg"]).select("seg", "bleu").orderBy("bleu", "seg").limit(20)


def _two_refs_sql() -> str:
    words = lambda c: f"list_filter(string_split_regex({_13A.format(c)}, ' +'), lambda w: w <> '')"
    gram = "unnest(list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string(list_slice({0}, i, i + n - 1), ' ')))"
    of = lambda c: f"(SELECT seg, n, g, count(*) AS c FROM (SELECT seg, n, {gram.format(c)} AS g FROM tok, orders WHERE len({c}) >= n) GROUP BY ALL)"
    return f"""{_PAIRS}, three AS (SELECT conv_id * 1000 + turn AS seg, src, tgt, lead(tgt) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM pairs),
  tok AS (SELECT seg, {words('src')} AS h, {words('tgt')} AS r, {words("coalesce(other, '')")} AS o FROM three), orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
  m AS (SELECT seg, n, sum(least(a.c, greatest(coalesce(b.c, 0), coalesce(d.c, 0)))) AS correct, sum(a.c) AS total FROM {of('h')} a LEFT JOIN {of('r')} b USING (seg, n, g) LEFT JOIN {of('o')} d USING (seg, n, g) GROUP BY ALL),
  w AS (SELECT seg, {', '.join(f"coalesce(sum({k}) FILTER (WHERE n = {i}), 0) AS {k}_{i}" for k in ('correct', 'total') for i in (1, 2, 3, 4))} FROM m GROUP BY seg),
  st AS (SELECT tok.seg, len(h) AS sys_len, CASE WHEN abs(len(r) - len(h)) < abs(len(o) - len(h)) OR (abs(len(r) - len(h)) = abs(len(o) - len(h)) AND len(r) <= len(o)) THEN len(r) ELSE len(o) END AS ref_len, w.* EXCLUDE (seg) FROM tok LEFT JOIN w USING (seg))"""


@query(f"{_two_refs_sql()}, s AS (SELECT count(*) AS n_segments, {_SUMS} FROM st) SELECT *, {_BLEU_SQL} FROM s")
def multiref_bleu(t):
    """Against the answer and the next answer of the conversation, as two references."""
    pairs = turn_pairs(t("conversations")).withColumn("seg", F.col("conv_id") * 1000 + F.col("turn"))
    two = pairs.withColumn("other", F.lead("tgt").over(Window.partitionBy("conv_id").orderBy("turn")))
    return A.bleu(A.segment_stats(two, "seg", A.tokens_13a(F.col("src")), [A.tokens_13a(F.col("tgt")), A.tokens_13a(F.coalesce("other", F.lit("")))]))


def _chrf_sql() -> str:
    words = lambda c: f"list_filter(string_split_regex({_13A.format(c)}, ' +'), lambda w: w <> '')"
    letters = lambda c: f"string_split(regexp_replace({c}, '[\\s\\x{{A0}}]+', '', 'g'), '')"
    gram = "unnest(list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string(list_slice({0}, i, i + n - 1), chr(1))))"
    of = lambda c: f"(SELECT seg, kind, n, g, count(*) AS c FROM (SELECT seg, kind, n, {gram.format(c)} AS g FROM tok JOIN orders USING (kind) WHERE len({c}) >= n) GROUP BY ALL)"
    return f"""{_PAIRS}, tok AS (SELECT conv_id * 1000 + turn AS seg, 'w' AS kind, {words('src')} AS h, {words('tgt')} AS r FROM pairs UNION ALL SELECT conv_id * 1000 + turn, 'c', {letters('src')}, {letters('tgt')} FROM pairs),
  orders AS (SELECT * FROM (VALUES ('c', 1), ('c', 2), ('c', 3), ('c', 4), ('c', 5), ('c', 6), ('w', 1), ('w', 2)) AS v(kind, n)),
  a AS {of('h')}, b AS {of('r')},
  x AS (SELECT kind, n, sum(least(a.c, b.c)) AS m FROM a JOIN b USING (seg, kind, n, g) GROUP BY ALL), y AS (SELECT kind, n, sum(c) AS h FROM a GROUP BY ALL), z AS (SELECT kind, n, sum(c) AS r FROM b GROUP BY ALL),
  e AS (SELECT avg(coalesce(m, 0)::DOUBLE / h) AS p, avg(coalesce(m, 0)::DOUBLE / r) AS q FROM y JOIN z USING (kind, n) LEFT JOIN x USING (kind, n))
  SELECT round(CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0 END, 4) AS chrfpp FROM e"""


@query(_chrf_sql())
def chrfpp(t):
    pairs = turn_pairs(t("conversations")).withColumn("seg", F.col("conv_id") * 1000 + F.col("turn"))
    return A.chrf(pairs, "seg", F.col("src"), F.col("tgt"))


@query(rf"""{_PAIRS}, h AS (SELECT unnest(regexp_extract_all(lower(src), '[a-z'']+')) AS w FROM pairs), r AS (SELECT DISTINCT unnest(regexp_extract_all(lower(tgt), '[a-z'']+')) AS w FROM pairs)
  SELECT count(*) AS words, round(count(*) FILTER (WHERE w IN (SELECT w FROM r)) / count(*), 6) AS rate FROM h""")
def sanity_rate(t):
    pairs = turn_pairs(t("conversations"))
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1))).alias("w")
    counts = pairs.select(words("src")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    known = pairs.select(words("tgt")).distinct().withColumn("known", F.lit(1))
    return counts.join(known, "w", "left").agg(F.sum("c").alias("words"), F.round(F.sum(F.when(F.col("known") == 1, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("rate"))


# ---------------------------------------------------------------- token ids


def _ids(t) -> DataFrame:
    """Stand-in ids: the length of each word, from 10 on."""
    return t("documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w) + 10).alias("ids"))


_IDS_SQL = "WITH i AS (SELECT doc_id, list_concat([2], list_concat(list_transform(string_split(text, ' '), lambda w: length(w) + 10), [3])) AS ids FROM documents)"


@query(f"{_IDS_SQL} SELECT doc_id, len(ids) AS n, md5(array_to_string(ids, ' ')) AS ids_md5 FROM i WHERE len(ids) <= 150")
def encode_frame_filter(t):
    framed = _ids(t).select("doc_id", X.frame_ids(F.col("ids")).alias("ids")).filter(F.size("ids") <= 150)
    return framed.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids_md5"))


@query(f"{_IDS_SQL} SELECT doc_id, md5(array_to_string(CASE WHEN len(ids) > 150 THEN list_append(ids[1:149], 3) ELSE ids END, ' ')) AS ids_md5 FROM i")
def truncate_keep_eos(t):
    cut = _ids(t).select("doc_id", X.truncate_ids(X.frame_ids(F.col("ids")), 150).alias("ids"))
    return cut.select("doc_id", F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids_md5"))


@query(f"{_IDS_SQL}, k AS (SELECT doc_id, doc_id // 32 AS batch, CASE WHEN len(ids) > 150 THEN list_append(ids[1:149], 3) ELSE ids END AS ids FROM i), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM k) SELECT doc_id, width, md5(array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ' ')) AS padded_md5 FROM w")
def pad_shift(t):
    cut = _ids(t).select("doc_id", F.floor(F.col("doc_id") / 32).alias("batch"), X.truncate_ids(X.frame_ids(F.col("ids")), 150).alias("ids"))
    wide = cut.withColumn("width", F.max(F.size("ids")).over(Window.partitionBy("batch")))
    padded = X.pad_ids(F.col("ids"), F.col("width"))
    return wide.select("doc_id", F.col("width").cast("long").alias("width"), F.md5(F.array_join(F.transform(padded, lambda x: x.cast("string")), " ")).alias("padded_md5"))


# ---------------------------------------------------------------- batches, comparisons, sets


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // 32 AS BIGINT) AS batch FROM documents")
def length_sorted_batches(t):
    place = F.row_number().over(Window.partitionBy("lang").orderBy("n_chars", "doc_id"))
    return t("documents").select("doc_id", F.floor((place - 1) / 32).alias("batch"))


@query("SELECT o_orderpriority, max_by(o_orderstatus, m) AS best, round(max(m), 4) AS score FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY o_orderpriority")
def best_of_grid(t):
    grid = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    return grid.groupBy("o_orderpriority").agg(F.max_by("o_orderstatus", "m").alias("best"), F.round(F.max("m"), 4).alias("score"))


@query("SELECT event_type, round(avg(value) - (SELECT avg(value) FROM events WHERE event_type = (SELECT min(event_type) FROM events)), 6) AS difference FROM events GROUP BY event_type")
def baseline_difference(t):
    means = t("events").groupBy("event_type").agg(F.avg("value").alias("m"))
    base = means.agg(F.min_by("m", "event_type").alias("base"))
    return means.join(F.broadcast(base)).select("event_type", F.round(F.col("m") - F.col("base"), 6).alias("difference"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def key_intersection(t):
    keys = lambda s: t("orders").filter(F.col("o_orderstatus") == s).select("o_custkey")
    return keys("F").intersect(keys("O"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def key_difference(t):
    return t("customer").select("c_custkey").exceptAll(t("orders").select("o_custkey").distinct())


_MOSES_SQL = "text"
for _p, _r in ((r"\s+", " "), (r"([^\p{L}\p{N}\s.''`,-])", r" \1 "), (r"([^\p{N}]),", r"\1 , "), (r",([^\p{N}])", r" , \1"), (r"([^\p{L}])''", r"\1 '' "), (r"(\p{L})''(\p{L})", r"\1 ''\2"), (r"\.\s*$", " ."), (r"\s+", " ")):
    _MOSES_SQL = f"regexp_replace({_MOSES_SQL}, '{_p}', '{_r}', 'g')"


@query(f"SELECT doc_id, trim({_MOSES_SQL}) AS tokens FROM documents")
def moses_tokenise(t):
    return t("documents").select("doc_id", X.moses_tokens(F.col("text")).alias("tokens"))


@query()
def domain_shift(t):
    e = t("embeddings")
    auc = A.domain_shift_auc(e, "embedding", F.col("label") < 5, "vec_id")
    mmd, p = A.mean_discrepancy(e, "embedding", F.col("label") < 5, "vec_id", 1.0)
    return e.sparkSession.createDataFrame([(auc, mmd, p)], "auc double, mmd2 double, p_value double")


@query("SELECT page_id, n = 1 AS only_page FROM (SELECT page_id, count(*) OVER (PARTITION BY " + _HOST_SQL + ") AS n FROM pages)")
def domain_singletons(t):
    d = _domains(t).select("page_id", "host")
    counts = d.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return d.join(counts, "host").select("page_id", (F.col("n") == 1).alias("only_page"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.02 AND l_extendedprice > 1000")
def mined_scan(t):
    """Three strict floors over the largest table, pushed to the scan."""
    return mined_pairs(t("lineitem"), {"l_quantity": 10, "l_discount": 0.02, "l_extendedprice": 1000}, {}, "double").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- named studies


_LABELLED = "(SELECT d.doc_id, d.source, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id))"


def _arm_rows(arms: dict[str, DataFrame]) -> DataFrame:
    first, second = (df.select(F.lit(name).alias("arm"), "doc_id") for name, df in arms.items())
    return first.unionByName(second)


@query(f"SELECT 'narrow' AS arm, doc_id FROM documents WHERE source = 'src0' AND text IS NOT NULL UNION ALL SELECT 'broad', doc_id FROM (SELECT doc_id FROM {_LABELLED} WHERE quality > 0.5 ORDER BY n_chars DESC, doc_id LIMIT 200)")
def domain_arms(t):
    """One source whole against the 200 longest labelled documents above a floor."""
    docs = t("documents")
    return _arm_rows(S.domain_arms(docs.filter("source = 'src0'"), docs.join(t("labels").select("doc_id", "quality"), "doc_id"), "n_chars", {"quality": 0.5}, 200, ["text"], ["doc_id"]))


@query(f"SELECT 'first' AS arm, doc_id FROM {_LABELLED} WHERE source = 'src1' AND quality > 0.15 UNION ALL SELECT 'other', doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE source <> 'src1') WHERE r <= (SELECT count(*) FROM {_LABELLED} WHERE source = 'src1' AND quality > 0.15)")
def matched_arms(t):
    """The labelled documents of a source above a floor, and as many of the longest of all others."""
    docs = t("documents")
    first = docs.filter("source = 'src1'").join(t("labels").select("doc_id", "quality"), "doc_id").filter("quality > 0.15")
    return _arm_rows(S.matched_arms(first, docs.filter("source != 'src1'"), "n_chars", None, ["doc_id"]))


@query("SELECT lang AS arm, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha1(concat_ws(chr(0), '42', CAST(doc_id AS VARCHAR))), doc_id) AS r FROM documents WHERE lang IN ('de', 'en')) WHERE r <= (SELECT least(count(*) FILTER (WHERE lang = 'de'), count(*) FILTER (WHERE lang = 'en')) FROM documents)")
def equal_arms(t):
    """Two languages cut to the size of the smaller one, in seeded order."""
    return _arm_rows(S.equal_sized({x: t("documents").filter(F.col("lang") == x) for x in ("de", "en")}, "doc_id"))


@query(f"{_PAIRS} SELECT conv_id, turn, len(string_split(tgt, ' ')) + 2 AS n_src, len(string_split(src, ' ')) + 2 AS n_tgt FROM pairs WHERE len(string_split(tgt, ' ')) <= 148 AND len(string_split(src, ' ')) <= 148")
def reversed_encode(t):
    """The other direction's framed ids; stand-in ids as above."""
    encode = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w) + 10)
    same = lambda c: c
    arm = S.encoded_arm(S.reversed_pairs(turn_pairs(t("conversations"))), encode, same, same)
    return arm.select("conv_id", "turn", F.size("src").cast("long").alias("n_src"), F.size("tgt").cast("long").alias("n_tgt"))


@query("SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def mean_tensors(t):
    """The mean of each place of equally labelled vectors, as of checkpoints' tensors."""
    return S.mean_tensors(t("embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 5))


@query("SELECT event_type, user_id % 5 AS seed, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std FROM events GROUP BY ALL")
def seed_report(t):
    return S.seed_report(t("events").withColumn("seed", F.col("user_id") % 5), ["event_type", "seed"], "value")


# ---------------------------------------------------------------- the flagship


@query(f"SELECT lang, {_BUCKET.format('text')} AS bucket, count(*) AS n FROM (SELECT lang, text FROM (SELECT doc_id, lang, " + _STRIP_SQL.format(r"regexp_replace(text, '[\s\x{A0}]+', ' ', 'g')") + f" AS text FROM documents) WHERE length(text) > 5 AND length(text) < 2000 QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) GROUP BY ALL")
def clean_dedupe_bucket(t):
    docs = t("documents").select("doc_id", "lang", X.collapse_space(F.col("text")).alias("text"))
    kept = R.keep_first(docs.filter(R.length_between(F.col("text"), 5, 2000)), ["text"], ["doc_id"])
    return kept.groupBy("lang", X.length_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
