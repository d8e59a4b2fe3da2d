"""The reference operators' queries over the driver tables, and their SQL.

The tables hold no images, so each operator runs on an analogue: documents are works, conversations
are folders of turns, embeddings give page hashes (the sign of each component), parts give names,
line items give episode numbers. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..functions import text as X
from ..operators import actions, classify, exact, index, near, runs
from ..operators.components import connected_components
from ..operators.ordering import numbered
from ..shipping import work_folder
from ..sources import events, tree

#: Thresholds of the embedding queries: the sign hashes of the tables lie about 32 bits apart.
EMBEDDING_THRESHOLD, EMBEDDING_GOOD, EMBEDDING_RATIO = 24.25, 22, 0.5
CREATOR_THRESHOLD, CREATOR_GOOD = 34, 33
PAGES_IN_WORK = 8
CHUNK = 200


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as works -------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("_"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", name.alias("name"), F.sha2(F.col("text"), 256).alias("digest"), F.col("n_chars").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("bytes"), "lang", "source")


def exact_groups(spark, sf_dir):
    found = exact.exact_groups(_documents(spark, sf_dir), "digest", "doc_id")
    return found.select("digest", "n", F.col("first").alias("first_id"), F.col("member").alias("doc_id"))


def _keepers(spark, sf_dir):
    return exact.exact_keeper(_documents(spark, sf_dir), "digest", F.col("name"), F.col("name"))


def exact_keeper(spark, sf_dir):
    return _keepers(spark, sf_dir).select("digest", "doc_id", "n", "is_keeper")


def exact_survivors(spark, sf_dir):
    gone = _keepers(spark, sf_dir).where(~F.col("is_keeper"))
    return exact.survivors(_documents(spark, sf_dir), gone, "doc_id").select("doc_id", "digest")


_DOCS = """d AS (SELECT doc_id, coalesce(source, 'none') || '_' || CAST(doc_id AS VARCHAR) AS name, sha256(text) AS digest,
  CAST(n_chars AS BIGINT) AS n_chars, CAST(strlen(text) AS BIGINT) AS bytes, lang, source, text FROM documents)"""
# A derived name has no noise words, no dots and only letters, digits and underscores: the shortest, then the first.
_KEEP = f"""WITH {_DOCS},
g AS (SELECT *, count(*) OVER (PARTITION BY digest) AS n,
  row_number() OVER (PARTITION BY digest ORDER BY length(name), lower(name)) = 1 AS is_keeper FROM d WHERE digest IS NOT NULL)"""


def size_format(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return docs.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")).select("source", "bytes", X.format_size(F.col("bytes")).alias("total"), X.format_size(F.col("largest")).alias("most"), X.format_size(-F.col("largest")).alias("freed"))


def _format_sql(x: str) -> str:
    return f"""CASE WHEN abs({x}) < 1024 THEN CAST({x} AS VARCHAR) || ' B'
  WHEN abs({x}) < 1048576 THEN printf('%.2f KB', CAST({x} AS DOUBLE) / 1024)
  WHEN abs({x}) < 1073741824 THEN printf('%.2f MB', CAST({x} AS DOUBLE) / 1048576)
  ELSE printf('%.2f GB', CAST({x} AS DOUBLE) / 1073741824) END"""


def page_budget(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    budget = X.page_budget(F.col("bytes"), cap_mb=0.004)
    return docs.select("doc_id", budget.alias("budget"), F.round(X.scale_for_budget(F.col("bytes") * 3, budget), 9).alias("scale"))


# --- conversations as folders of pages ----------------------------------------------------------


def work_digest(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").withColumn("page", F.concat(F.col("turn").cast("string"), F.lit("_"), F.col("role"), F.lit(".TXT")))
    found = exact.folder_digest(turns, "conv_id", "page", "text")
    prints = exact.content_fingerprint(turns.withColumn("size", F.octet_length("text")), "conv_id", "page", "size", "turn")
    return found.join(prints, "conv_id").select("conv_id", "n_pages", "digest", "fingerprint")


def page_sample(spark, sf_dir):
    """Sampled chunks of documents (a page is 200 characters), for 12 and for 3 pages."""
    pages = _documents(spark, sf_dir).withColumn("pages", F.ceil(F.col("n_chars") / CHUNK).cast("long"))
    text = lambda k: F.array_join(F.transform(S.page_indices(F.col("pages"), k), lambda x: x.cast("string")), ",")
    return pages.select("doc_id", "pages", text(12).alias("twelve"), text(3).alias("three"), text(1).alias("one"))


def _sample_sql(k: int) -> str:
    every = "list_transform(range(pages), lambda i: CAST(i AS BIGINT))"
    if k == 1:
        return f"CASE WHEN pages <= 1 THEN array_to_string({every}, ',') ELSE CAST(pages // 2 AS VARCHAR) END"
    s, e = "CAST(trunc(pages * CAST(0.1 AS DOUBLE)) AS BIGINT)", "CAST(trunc(pages * CAST(0.9 AS DOUBLE)) AS BIGINT) - 1"
    start, end = f"(CASE WHEN greatest({s}, {e}) <= {s} THEN 0 ELSE {s} END)", f"(CASE WHEN greatest({s}, {e}) <= {s} THEN pages - 1 ELSE {e} END)"
    at = f"least(pages - 1, CAST(trunc(CAST({start} AS DOUBLE) + (CAST({end} - {start} AS DOUBLE) / {k - 1}) * i) AS BIGINT))"
    return f"CASE WHEN pages <= {k} THEN array_to_string({every}, ',') ELSE array_to_string(list_sort(list_distinct(list_transform(range({k}), lambda i: {at}))), ',') END"


# --- embeddings as page hashes ------------------------------------------------------------------


def _hashes(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", S.sign_hash(F.col("embedding")).alias("hash"))


def page_hash(spark, sf_dir):
    hashed = _hashes(spark, sf_dir).select("vec_id", S.hash_to_hex(F.col("hash")).alias("hex"), F.bit_count("hash").alias("ones"))
    return hashed.withColumn("back", S.hash_to_hex(S.hex_to_hash(F.col("hex"))))


def _signatures(spark, sf_dir) -> DataFrame:
    page = F.array_sort(F.collect_list(F.struct("vec_id", "hash")))
    grouped = _hashes(spark, sf_dir).groupBy(F.expr(f"vec_id div {PAGES_IN_WORK}").alias("ord")).agg(page.alias("p"), F.max("label").alias("top"))
    # Works whose first page has label 0 have an unknown page count.
    return grouped.select("ord", F.transform("p", lambda x: x["hash"]).alias("signature"), F.when(F.col("top") == 9, 0).otherwise(F.size("p") + F.col("top") * 3).cast("int").alias("pages"))


def signature(spark, sf_dir):
    return _signatures(spark, sf_dir).select("ord", "pages", F.array_join(F.transform("signature", S.hash_to_hex), ",").alias("signature"))


def pair_distance(spark, sf_dir):
    works = _signatures(spark, sf_dir).withColumn("pages", F.lit(1))
    return _rounded(near.pair_distances(near.candidate_pairs(works, 5), EMBEDDING_GOOD))


def pair_distance_gated(spark, sf_dir):
    return _rounded(near.pair_distances(near.candidate_pairs(_signatures(spark, sf_dir), 5), EMBEDDING_GOOD))


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.select("ord_a", "ord_b", F.round("distance", 9).alias("distance"), F.round("good_ratio", 9).alias("good_ratio"))


def near_works(spark, sf_dir):
    found = near.near_groups(_signatures(spark, sf_dir), threshold=EMBEDDING_THRESHOLD, tolerance=5, good=EMBEDDING_GOOD, good_ratio=EMBEDDING_RATIO)
    return found.select("ord", "group_id")


_HASH = f"""h AS (SELECT vec_id, label, list_reduce(list_transform(range(64), lambda i:
  CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS UBIGINT) << CAST(i AS UBIGINT) ELSE CAST(0 AS UBIGINT) END), lambda a, b: a | b) AS hash
  FROM embeddings WHERE embedding IS NOT NULL)"""
_SIG = f"""{_HASH}, s AS (SELECT vec_id // {PAGES_IN_WORK} AS ord, list(hash ORDER BY vec_id) AS signature,
  CAST(CASE WHEN max(label) = 9 THEN 0 ELSE count(*) + 3 * max(label) END AS INTEGER) AS pages FROM h GROUP BY 1)"""


def _pairs_sql(gate: str, good: int = EMBEDDING_GOOD) -> str:
    """Common table pair(ord_a, ord_b, distance, good_ratio); the query side is the shorter signature."""
    return f"""{_SIG},
p AS (SELECT a.ord AS ord_a, b.ord AS ord_b,
  CASE WHEN len(b.signature) < len(a.signature) THEN b.signature ELSE a.signature END AS q,
  CASE WHEN len(b.signature) < len(a.signature) THEN a.signature ELSE b.signature END AS t
  FROM s a JOIN s b ON a.ord < b.ord AND {gate}),
m AS (SELECT ord_a, ord_b, list_transform(q, lambda x: list_min(list_transform(t, lambda y: bit_count(xor(x, y))))) AS least FROM p),
pair AS (SELECT ord_a, ord_b, CAST(list_sum(least) AS DOUBLE) / len(least) AS distance,
  CAST(len(list_filter(least, lambda x: x <= {good})) AS DOUBLE) / len(least) AS good_ratio FROM m)"""


_GATE = "(a.pages = 0 OR b.pages = 0 OR abs(a.pages - b.pages) <= 5)"


def _closure_sql(pairs: str) -> str:
    """Least member of each node's component over table e(a, b)."""
    return f"""e AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}),
walk(node, seen) AS (SELECT a, a FROM e UNION SELECT walk.node, e.b FROM walk JOIN e ON e.a = walk.seen)"""


def _creators(spark, sf_dir):
    hashes = _hashes(spark, sf_dir).where("label is not null")
    own = hashes.withColumn("signature", F.array("hash"))
    tagged = own.where("label <> 0").withColumn("creator", F.concat(F.lit("artist"), F.col("label").cast("string")))
    return own.where("label = 0"), classify.profiles(tagged, "creator", "signature", 3)


def classify_scores(spark, sf_dir):
    untagged, known = _creators(spark, sf_dir)
    return classify.scores(untagged, "vec_id", "signature", known, CREATOR_GOOD)


def classify_suggest(spark, sf_dir):
    return classify.suggestions(classify_scores(spark, sf_dir), "vec_id", CREATOR_THRESHOLD)


_SCORES = f"""{_HASH},
m AS (SELECT u.vec_id, 'artist' || CAST(p.label AS VARCHAR) AS creator, CAST(bit_count(xor(u.hash, p.hash)) AS DOUBLE) AS d
  FROM h u JOIN h p ON u.label = 0 AND p.label <> 0
   AND p.label IN (SELECT label FROM h WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 3)),
sc AS (SELECT vec_id, creator, median(d) AS avg_distance, median(CASE WHEN d <= {CREATOR_GOOD} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS good_ratio,
  count(*) AS sample_count FROM m GROUP BY ALL)"""
_SUGGEST = f"""WITH {_SCORES},
o AS (SELECT *, row_number() OVER w AS r, lead(avg_distance) OVER w AS nxt FROM sc
  WINDOW w AS (PARTITION BY vec_id ORDER BY avg_distance, good_ratio DESC, sample_count DESC, lower(creator), creator)),
b AS (SELECT *, coalesce(nxt - avg_distance, CAST('infinity' AS DOUBLE)) AS margin FROM o WHERE r = 1),
l AS (SELECT vec_id, creator, avg_distance, good_ratio, sample_count, margin,
  CASE WHEN avg_distance <= {CREATOR_THRESHOLD - 4} AND good_ratio >= 0.6 AND sample_count >= 5 AND margin >= 2 THEN 'high'
       WHEN avg_distance <= {CREATOR_THRESHOLD} AND good_ratio >= 0.45 AND margin >= 1.5 THEN 'medium'
       WHEN avg_distance <= {CREATOR_THRESHOLD} AND good_ratio >= 0.35 THEN 'low' ELSE 'none' END AS confidence FROM b)
SELECT * FROM l WHERE confidence <> 'none'"""


# --- near duplicates of documents by SimHash ------------------------------------------------------

SIMHASH_RADIUS = 3


def _simhashes(spark, sf_dir) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    hashed = words.select("doc_id", F.conv(F.substring(F.md5("w"), 1, 16), 16, -10).cast("long").alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1).cast("long")) * 2 - 1).alias(f"b{i}") for i in range(64)]
    bits = hashed.groupBy("doc_id").agg(*sums)
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return bits.select("doc_id", value.alias("hash"))


def near_groups(spark, sf_dir):
    pairs = near.banded_pairs(_simhashes(spark, sf_dir), "doc_id", "hash", SIMHASH_RADIUS)
    return connected_components(pairs, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def near_keeper(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("pages", F.ceil(F.col("n_chars") / CHUNK).cast("long"))
    members = docs.join(near_groups(spark, sf_dir), "doc_id")
    return _ranked(members)


def _ranked(members: DataFrame) -> DataFrame:
    ranked = exact.quality_rank(members, "group_id", "pages", "n_chars", "pages", "bytes", "name")
    return ranked.select("doc_id", "group_id", F.col("rank").cast("int").alias("rank"), "is_keeper")


_SIM = (
    """w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
x AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 16) AS UBIGINT) AS h FROM w),
v AS (SELECT doc_id, """
    + " | ".join(f"(CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN CAST(1 AS UBIGINT) << {i} ELSE CAST(0 AS UBIGINT) END)" for i in range(64))
    + f""" AS hash FROM x GROUP BY doc_id),
np AS (SELECT a.doc_id AS a, b.doc_id AS b FROM v a JOIN v b ON a.doc_id < b.doc_id AND bit_count(xor(a.hash, b.hash)) <= {SIMHASH_RADIUS}),
{_closure_sql("np")},
g AS (SELECT node AS doc_id, min(seen) AS group_id FROM walk GROUP BY node)"""
)


# --- names, episodes, runs ------------------------------------------------------------------------


def _part_names(spark, sf_dir) -> DataFrame:
    """Names with brackets, noise words, tags of many kinds and episode numbers, from the columns of part."""
    parts = _read(spark, sf_dir, "part")
    size, kind = F.col("p_size"), F.length("p_type") % 8
    series = F.split("p_name", " ")[0]
    tag = F.element_at(F.array(*map(F.lit, ["English Version", "digital", "CHINESE", "raw", "Complete ver.", "xx汉化", "Fan Club"])), (size % 7 + 1).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, ["_EP_", "_Chapter_", " ", "-", "#", "_vol_", "第", "_episode_"])), (kind + 1).cast("int"))
    end = F.when(kind == 6, "話").otherwise("")
    noise = F.when(size % 5 == 0, " Copy (2)").when(size % 5 == 1, "  duplicate  ").otherwise("")
    return parts.select(
        "p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size"),
        F.concat(F.lit("【"), F.col("p_brand"), F.lit("】"), F.upper("p_name"), F.lit("("), tag, F.lit(")"), F.initcap("p_type"), noise).alias("name"),
        F.concat(series, mark, size.cast("string"), end).alias("episode_name"),
        F.concat(F.element_at(F.array(*map(F.lit, ["[", "(", "（", "【"])), (size % 4 + 1).cast("int")), tag, F.element_at(F.array(*map(F.lit, ["]", ")", "）", "】"])), (size % 4 + 1).cast("int")),
                 F.lit(" ["), F.col("p_brand"), F.lit("]"), F.col("p_name")).alias("tagged"),
    )


_TAG_SQL = "['English Version', 'digital', 'CHINESE', 'raw', 'Complete ver.', 'xx汉化', 'Fan Club'][1 + p_size % 7]"
_NAMES = f"""n AS (SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size, p_name, p_type, {_TAG_SQL} AS tag,
  split_part(p_name, ' ', 1) || ['_EP_', '_Chapter_', ' ', '-', '#', '_vol_', '第', '_episode_'][1 + length(p_type) % 8] || CAST(p_size AS VARCHAR) || CASE WHEN length(p_type) % 8 = 6 THEN '話' ELSE '' END AS episode_name,
  ['[', '(', '（', '【'][1 + p_size % 4] || {_TAG_SQL} || [']', ')', '）', '】'][1 + p_size % 4] || ' [' || p_brand || ']' || p_name AS tagged
  FROM part)"""


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _title_sql(x: str) -> str:
    """The first ASCII letter of each word in upper case, those after it in lower case; words end at spaces and underscores."""
    word = r"regexp_extract(w, '^([^A-Za-z]*)([A-Za-z]?)', 1) || upper(regexp_extract(w, '^[^A-Za-z]*([A-Za-z]?)', 1)) || translate(substr(w, 1 + length(regexp_extract(w, '^[^A-Za-z]*[A-Za-z]?'))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"array_to_string(list_transform(string_split(u, '_'), lambda w: {word}), '_')"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda u: {words}), ' ')"


def _episode_sql(x: str, part: int) -> str:
    """Prefix (1), number (2) or suffix (3) of the first episode pattern that fits; null if none does."""
    patterns = [rf"(?i)^(.+?{m})([0-9]+)()$" for m in X.EPISODE_MARKERS] + [rf"^(.+{m})([0-9]+)()$" for m in (" ", "-", "#")] + ["^(.+第)([0-9]+)([话話集卷])$"]
    cases = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', {part})" for p in patterns)
    return f"CASE {cases} END"


# The rules of standard names, one table a step: invalid characters and copy numbers, noise words, brackets and their
# spacing, then the tags and the texts between them.
_DELIMITED = r"\[[^\]]*\]|\([^)]*\)"
_STEPS = rf"""s1 AS (SELECT *, trim(regexp_replace(regexp_replace(trim(raw), '[<>:"/\\|?*]', '', 'g'), '\(\s*[0-9]+\s*\)\s*$', '')) AS a FROM raw_names),
s2 AS (SELECT *, regexp_replace(regexp_replace(a, '(?i)(?:^|\s)copy(?:\s|$)', ' ', 'g'), '(?i)(?:^|\s)duplicate(?:\s|$)', ' ', 'g') AS b FROM s1),
s3 AS (SELECT *, translate(b, '{X.BRACKETS_FROM}', '{X.BRACKETS_TO}') AS c FROM s2),
s4 AS (SELECT *, regexp_replace(regexp_replace(c, '([^(\[\s])([(\[])', '\1 \2', 'g'), '([)\]])([^)\](\[\s])', '\1 \2', 'g') AS d FROM s3),
s5 AS (SELECT *, trim(regexp_replace(d, '\s+', ' ', 'g'), ' .') AS e FROM s4),
s6 AS (SELECT *, string_split_regex(e, '{_DELIMITED}') AS texts, regexp_extract_all(e, '{_DELIMITED}') AS tags FROM s5),
s7 AS (SELECT *, list_transform(tags, lambda g: struct_pack(o := g[1:1], t := trim(g[2:-2]), c := g[-1:])) AS found FROM s6),
s8 AS (SELECT *, list_transform(found, lambda g: struct_pack(o := g.o, c := g.c, t := g.t, f := lower(g.t), s := lower(regexp_replace(g.t, '(?i)(?:\s+(?:version\.?|ver\.?|版))+$', '')))) AS keyed FROM s7),
s9 AS (SELECT *, list_transform(keyed, lambda g: CASE WHEN g.t = '' THEN ' '
    WHEN codes[g.f] IS NOT NULL THEN g.o || codes[g.f] || g.c WHEN codes[g.s] IS NOT NULL THEN g.o || codes[g.s] || g.c
    WHEN list_contains({_sql_list(X.DROPPED_TAGS)}, g.f) OR list_contains({_sql_list(X.DROPPED_TAGS)}, g.s) OR regexp_matches(g.t, '{"|".join(X.TRANSLATOR_MARKERS)}') THEN ' '
    ELSE g.o || g.s || g.c END) AS shown FROM s8, (SELECT MAP {{{", ".join(f"'{k}': '{v}'" for k, v in X.LANGUAGE_CODES.items())}}} AS codes)),
s10 AS (SELECT *, array_to_string(list_transform(range(1, len(texts) + 1), lambda i: texts[i] || coalesce(shown[i], '')), '') AS f FROM s9),
s11 AS (SELECT *, string_split_regex(f, '{_DELIMITED}') AS between_, regexp_extract_all(f, '{_DELIMITED}') AS kept FROM s10),
s12 AS (SELECT *, list_transform(between_, lambda t: CASE WHEN trim(t) = '' THEN t ELSE regexp_extract(t, '^ *') || {_title_sql("trim(t)")} || regexp_extract(t, ' *$') END) AS titled FROM s11),
s13 AS (SELECT *, trim(regexp_replace(array_to_string(list_transform(range(1, len(titled) + 1), lambda i: titled[i] || coalesce(kept[i], '')), ''), '\s+', ' ', 'g'), ' .') AS standard FROM s12)"""
_STD_SQL = f"""WITH {_NAMES}, raw_names AS (SELECT *, '【' || p_brand || '】' || upper(p_name) || '(' || tag || ')' || {_title_sql("lower(p_type)")}
  || CASE WHEN p_size % 5 = 0 THEN ' Copy (2)' WHEN p_size % 5 = 1 THEN '  duplicate  ' ELSE '' END AS raw FROM n),
{_STEPS}
SELECT p_partkey, CASE WHEN standard = '' THEN trim(raw) ELSE standard END AS standard FROM s13"""


def std_name(spark, sf_dir):
    return _part_names(spark, sf_dir).select("p_partkey", X.standard_name(F.col("name")).alias("standard"))


_STANDARD = f"""sn AS ({_STD_SQL}),
std AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN standard ELSE '*' END || CASE WHEN p_partkey % 3 = 0 THEN '.cbz' ELSE '' END AS name, standard, p_partkey % 3 = 0 OR p_size % 2 = 0 AS needs
  FROM sn JOIN part USING (p_partkey))"""


def episode_parse(spark, sf_dir):
    parsed = _part_names(spark, sf_dir).withColumn("e", X.parse_episode(F.col("episode_name")))
    return parsed.select("p_partkey", "episode_name", F.col("e.prefix").alias("prefix"), F.col("e.suffix").alias("suffix"), F.col("e.episode").alias("episode"), X.prefixed_page(F.col("p_size"), F.lit("001.jpg")).alias("page"))


_PARSED = f"""{_NAMES},
e AS (SELECT *, {_episode_sql("episode_name", 1)} AS prefix, {_episode_sql("episode_name", 3)} AS suffix, CAST({_episode_sql("episode_name", 2)} AS BIGINT) AS episode FROM n)"""


def merge_names(spark, sf_dir):
    groups = runs.merge_groups(_part_names(spark, sf_dir), "p_brand", "episode_name", "p_partkey")
    return groups.select("p_brand", "prefix", "suffix", "start", "end", "n", "merged_name")


_RUNS = """r AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY {number}, {order} ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN {number} = 1 + lag({number}) OVER (PARTITION BY {keys} ORDER BY {number}, {order}) THEN 0 ELSE 1 END AS fresh FROM {table})),
k AS (SELECT {keys}, run, min({number}) AS start, max({number}) AS "end", count(*) AS n FROM r GROUP BY {keys}, run HAVING count(*) >= 2)"""
_ANY_TAG = "|".join(rf"\{a}[^\{b}]*\{b}" if a in "[(" else f"{a}[^{b}]*{b}" for a, b in X.TAG_PAIRS)
_MERGED = f"""{_PARSED}, {_RUNS.format(keys="p_brand, prefix, suffix", number="episode", order="p_partkey", table="e")},
mm AS (SELECT *, regexp_extract(prefix, '^(.*?)(_EP_|_Chapter_|_vol_|_episode_|[ #第-])$', 1) AS title, regexp_extract(prefix, '(_EP_|_Chapter_|_vol_|_episode_|[ #第-])$') AS mark FROM k),
rk AS (SELECT p_brand, prefix, suffix, run, start, "end", n,
  list_aggregate(list_transform(string_split(title, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ')
  || CASE mark WHEN '_EP_' THEN '_Ep_' WHEN '_vol_' THEN '_Vol_' WHEN '_episode_' THEN '_Episode_' ELSE mark END
  || CAST(start AS VARCHAR) || CASE WHEN mark IN ('-', '#', '第') THEN 'to' ELSE 'To' END || CAST("end" AS VARCHAR) || suffix AS merged_name,
  row_number() OVER (ORDER BY lower(p_brand), lower(prefix), lower(suffix), start, p_brand, prefix, suffix, run) AS place FROM mm)"""


def episode_runs(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("number"), "l_partkey", "l_suppkey")
    found = runs.contiguous_runs(lines, ["l_orderkey"], "number", F.struct("l_partkey", "l_suppkey"))
    return found.select("l_orderkey", "start", "end", "n")


def creator_tags(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    creator = X.creator_tag(F.col("tagged"))
    return names.select("p_partkey", creator.alias("creator"), X.title_without_tags(F.col("tagged")).alias("title"), X.tagged_name(F.col("tagged"), F.lit("New")).alias("proposed"))


# --- pages as a directory tree ------------------------------------------------------------------


def archive_inventory(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^[a-z]+://", "")
    named = pages.select("page_id", path.alias("path")).withColumn("name", F.regexp_extract("path", "[^/]*$", 0)).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    return named.select(
        "page_id", "folder", "name", X.suffix(F.col("name")).alias("suffix"),
        X.suffix(F.col("name")).isin(tree.ARCHIVE_SUFFIXES).alias("is_archive"), tree.is_page(F.col("path"), F.col("name")).alias("is_page"), tree.is_junk(F.col("path"), F.col("name")).alias("is_junk"),
    )


def natural_order(spark, sf_dir):
    names = numbered(_documents(spark, sf_dir).select("doc_id", "lang", "name"), [F.col("lang"), X.natural_key(F.col("name"))], "place")
    first = names.groupBy(F.col("lang").alias("_lang")).agg(F.min("place").alias("_first"))
    return names.join(first, F.col("lang").eqNullSafe(F.col("_lang"))).select("doc_id", "lang", (F.col("place") - F.col("_first") + 1).cast("int").alias("place"))


def unique_names(spark, sf_dir):
    """Many claims of one name, names that are taken, gaps among taken numbers, and names that look numbered."""
    size = F.concat(F.lit("size"), F.col("p_size").cast("string"))
    name = F.when(F.col("p_partkey") % 11 == 0, F.concat(size, F.lit("__"), (F.col("p_partkey") % 4 + 1).cast("string"))).otherwise(size)
    wanted = _part_names(spark, sf_dir).select("p_partkey", F.col("p_brand").alias("parent"), name.alias("name"))
    taken = wanted.select("parent").distinct().withColumn("name", F.explode(F.array(*map(F.lit, ["size7", "size7__2", "size7__4", "size8__3", "size9__02"]))))
    return exact.unique_names(wanted, taken, "parent", "name", "p_partkey").select("p_partkey", "free_name")


# --- index ----------------------------------------------------------------------------------------


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Works (all documents) and an index of the labelled ones; low-quality labels are stale."""
    works = _documents(spark, sf_dir).select("doc_id", F.sha2(F.concat_ws(":", F.lit("file"), "doc_id", "n_chars"), 256).alias("fingerprint"), "digest", F.col("n_chars").alias("page_count"))
    labels = _read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    old = labels.join(works, "doc_id", "left")
    fp = F.when(F.col("quality") == 1, F.col("fingerprint")).otherwise("stale")
    return works, old.select("doc_id", fp.alias("quick_fingerprint"), F.col("digest").alias("exact_hash"), fp.alias("exact_fp"), F.when(F.col("quality") == 1, F.col("page_count")).otherwise(0).alias("page_count"))


def index_hits(spark, sf_dir):
    works, known = _snapshots(spark, sf_dir)
    found = index.lookup(works, known, "doc_id", "fingerprint", "exact_hash", "exact_fp")
    found = found.join(index.metadata_hit(works, known, "doc_id", "fingerprint").select("doc_id", F.col("is_hit").alias("scan_hit")), "doc_id")
    return found.select("doc_id", F.coalesce("is_hit", F.lit(False)).alias("is_hit"), "cached", "scan_hit")


def index_upsert(spark, sf_dir):
    works, known = _snapshots(spark, sf_dir)
    changes = works.select("doc_id", F.col("fingerprint").alias("quick_fingerprint"), F.lit(None).cast("string").alias("exact_hash"), F.when(F.col("page_count") > 1000, F.col("page_count")).alias("page_count"))
    return index.upsert(known, changes, "doc_id").select("doc_id", "quick_fingerprint", "exact_hash", "exact_fp", F.coalesce("page_count", F.lit(0)).alias("page_count"))


def index_prune(spark, sf_dir):
    works, known = _snapshots(spark, sf_dir)
    long = works.where("page_count > 1000")
    kept, removed = index.prune(known, long, "doc_id")
    return removed.join(kept.agg(F.count(F.lit(1)).alias("kept"), F.min("doc_id").alias("first")), F.lit(True))


_INDEX = f"""{_DOCS}, wk AS (SELECT doc_id, sha256('file:' || CAST(doc_id AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR)) AS fingerprint, digest, n_chars AS page_count FROM d),
ix AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN fingerprint ELSE 'stale' END AS fp, digest AS exact_hash,
  CASE WHEN quality = 1 THEN page_count ELSE 0 END AS page_count
  FROM (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) l LEFT JOIN wk USING (doc_id))"""


def index_remove(spark, sf_dir):
    """The index without the works that are gone: here, the longer documents."""
    _, known = _snapshots(spark, sf_dir)
    return index.remove(known, _read(spark, sf_dir, "documents").where("n_chars > 2000"), "doc_id").select("doc_id")


def index_metadata(spark, sf_dir):
    """Page counts and sizes of all works: of a fresh record as it has them, else found anew, else of the old record."""
    works, known = _snapshots(spark, sf_dir)
    sides = lambda df, w, h: df.withColumn("width", F.col("page_count") % w).withColumn("height", F.col("page_count") % h)
    found = sides(works.where("doc_id % 3 <> 0").select("doc_id", "page_count"), 5, 11)
    return index.ensure_metadata(works, sides(known, 7, 3), found, "doc_id", "fingerprint")


def signature_hits(spark, sf_dir):
    """Records whose signature was made from 12 pages."""
    records = _signatures(spark, sf_dir).select("ord", F.col("pages").alias("perceptual_num_pages"), F.col("signature").alias("perceptual_hashes"))
    return records.select("ord", F.col("perceptual_num_pages").alias("num_pages"), index.signature_hit(12).alias("is_hit"))


def trash_names(spark, sf_dir):
    """Places in the trash for removed copies that share a name within their source."""
    gone = _keepers(spark, sf_dir).where(~F.col("is_keeper")).select("doc_id", "source", F.lit("copy").alias("name"))
    nothing = gone.limit(0).select("source", "name")
    return exact.unique_names(gone, nothing, "source", "name", "doc_id", first=1).select("doc_id", F.col("free_name").alias("place"))


# --- actions ----------------------------------------------------------------------------------------


def _actions(spark, sf_dir) -> DataFrame:
    docs = _documents(spark, sf_dir)
    # Keepers are needed twice: their slim rows are written once.
    work_folder(spark)
    keepers = exact.exact_keeper(docs, "digest", F.col("name"), F.col("name")).select("digest", "doc_id", "bytes", "is_keeper").checkpoint()
    left = exact.survivors(docs, keepers.where(~F.col("is_keeper")), "doc_id")
    several = near_groups(spark, sf_dir).join(left, "doc_id").withColumn("pages", F.ceil(F.col("n_chars") / CHUNK).cast("long"))
    kept = exact.quality_keeper(several, "group_id", "pages", "n_chars", "pages", "bytes", "name")
    near_rows = actions.duplicate_actions(kept, "near", "group_id", "doc_id", "bytes")
    return actions.duplicate_actions(keepers, "exact", "digest", "doc_id", "bytes").unionByName(near_rows)


def plan_actions(spark, sf_dir):
    return _actions(spark, sf_dir).select("phase", "group_id", "kind", "src", "bytes")


def run_report(spark, sf_dir):
    planned = _actions(spark, sf_dir).unionByName(_standardise(spark, sf_dir)).unionByName(_merges(spark, sf_dir)).unionByName(_creator_renames(spark, sf_dir))
    total = actions.report(planned, _documents(spark, sf_dir))
    return total.select("discovered", "exact_removed", "near_removed", "bytes_reclaimed", "standardised", "merged", "suggestions", (F.col("exact_removed") + F.col("near_removed")).alias("total"), X.format_size(F.col("bytes_reclaimed")).alias("reclaimed"))


# --- a library of pages and archives ----------------------------------------------------------------


def _entries(spark, sf_dir) -> DataFrame:
    """A directory tree from the pages table: some pages lie in a host's own folder, whose subfolders then do not count."""
    n = F.col("page_id")
    host = F.concat(F.lit("/lib/"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))
    parent = F.when(n % 7 == 0, host).otherwise(F.concat(host, F.lit("/"), (n % 23).cast("string")))
    ending = F.element_at(F.array(*map(F.lit, [".JPG", ".webp", ".txt", ".CBZ", ".png", ".webp"])), (n % 6 + 1).cast("int"))
    name = F.concat(F.when(n % 13 == 0, "._").otherwise(""), F.lit("p"), n.cast("string"), ending)
    rows = _read(spark, sf_dir, "pages").select("page_id", parent.alias("parent"), name.alias("name"), F.octet_length("html").cast("long").alias("length"))
    return rows.select(F.concat("parent", F.lit("/"), "name").alias("path"), "parent", "name", F.lit(False).alias("is_dir"), "length", F.col("page_id").alias("mtime_ns"))


def works_inventory(spark, sf_dir):
    """Folders with pages and archives, each with its size, and whether its pages are to be converted."""
    entries = _entries(spark, sf_dir)
    found = tree.needs_page_conversion(tree.works(entries), tree.folder_pages(entries))
    return found.select("path", "kind", "parent", "name", "n_pages", "size", "needs_pages")


def page_order(spark, sf_dir):
    """Pages of folders in natural order, numbered from 0."""
    return tree.numbered_pages(tree.folder_pages(_entries(spark, sf_dir))).select("path", "work", F.col("page_no").cast("int").alias("page_no"))


_TREE = r"""e AS (SELECT page_id, parent, parent || '/' || name AS path, name, length FROM (
  SELECT page_id, '/lib/' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || CASE WHEN page_id % 7 = 0 THEN '' ELSE '/' || CAST(page_id % 23 AS VARCHAR) END AS parent,
    CASE WHEN page_id % 13 = 0 THEN '._' ELSE '' END || 'p' || CAST(page_id AS VARCHAR) || ['.JPG', '.webp', '.txt', '.CBZ', '.png', '.webp'][1 + page_id % 6] AS name,
    CAST(strlen(html) AS BIGINT) AS length FROM pages)),
pg AS (SELECT * FROM e WHERE page_id % 13 <> 0 AND page_id % 6 IN (0, 1, 4, 5)),
fo AS (SELECT parent AS path, 'folder' AS kind, count(*) AS n_pages, CAST(sum(length) AS BIGINT) AS size, bool_or(name NOT LIKE '%.webp') AS needs_pages FROM pg GROUP BY parent),
al AS (SELECT * FROM fo UNION ALL SELECT path, 'archive', NULL, length, true FROM e WHERE page_id % 6 = 3)"""


def file_prints(spark, sf_dir):
    """Digest of each page's bytes and quick fingerprints of files and folders."""
    pages = _read(spark, sf_dir, "pages")
    size = F.octet_length("html").cast("long")
    quick = lambda kind: exact.quick_fingerprint(F.lit(kind), size, F.col("page_id"))
    return pages.select("page_id", exact.file_digest(F.col("html").cast("binary")).alias("digest"), quick("archive").alias("file_print"), quick("folder").alias("folder_print"))


# --- choices, names to standard, merges, creators ---------------------------------------------------


def keeper_choice(spark, sf_dir):
    """Someone keeps the second best of the groups with an even id."""
    ranked = near_keeper(spark, sf_dir)
    overrides = ranked.where("group_id % 2 = 0").select("group_id", F.lit(2).alias("rank")).distinct()
    return exact.choose(ranked, overrides, "group_id").select("doc_id", "group_id", "is_keeper")


def _work_names(spark, sf_dir) -> DataFrame:
    """Works from parts: every third an archive, every fifth with its standard name already."""
    names = _part_names(spark, sf_dir)
    kind = F.when(F.col("p_partkey") % 3 == 0, "archive").otherwise("folder")
    name = F.when(F.col("p_partkey") % 5 == 0, X.standard_name(F.col("name"))).otherwise(F.col("name"))
    own = names.select("p_partkey", "p_size", kind.alias("kind"), F.concat(name, F.when(F.col("p_partkey") % 3 == 0, ".cbz").otherwise("")).alias("name"))
    needs = (F.col("kind") == "archive") | (F.col("p_size") % 2 == 0)
    return own.withColumn("standard", X.standard_folder_name(F.col("kind"), F.col("name"))).withColumn("needs_pages", needs)


def _standardise(spark, sf_dir) -> DataFrame:
    return actions.standardise_actions(_work_names(spark, sf_dir), "p_partkey", "p_size", "name", "standard", "needs_pages")


def standardise_plan(spark, sf_dir):
    return _standardise(spark, sf_dir).select("kind", "src", "dst")


def _merges(spark, sf_dir) -> DataFrame:
    return actions.merge_actions(runs.merge_members(_part_names(spark, sf_dir), "p_brand", "episode_name", "p_partkey", "p_partkey"))


def merge_plan(spark, sf_dir):
    """Which folders are merged into which, groups in the order of merging."""
    return _merges(spark, sf_dir).select(F.col("group_id").cast("long").alias("place"), "src", "dst", F.col("bytes").alias("episode"))


def _suggested(spark, sf_dir) -> DataFrame:
    return classify_suggest(spark, sf_dir).withColumn("name", F.concat(F.lit("work "), F.col("vec_id").cast("string")))


def _creator_renames(spark, sf_dir) -> DataFrame:
    return actions.creator_actions(_suggested(spark, sf_dir), "vec_id", F.col("name"))


def suggestion_order(spark, sf_dir):
    """Suggestions by confidence, distance and name, with the names they propose."""
    found = classify.ordered(_suggested(spark, sf_dir), "name")
    return found.select("vec_id", "creator", "confidence", F.col("place").cast("int").alias("place"), X.tagged_name(F.col("name"), F.col("creator")).alias("proposed"))


def tag_split(spark, sf_dir):
    """Works with and without a creator; an archive's suffix belongs to its name here."""
    names = _part_names(spark, sf_dir)
    plain = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Vol. "), F.col("p_size").cast("string"), F.lit(".cbz"))).otherwise(F.col("tagged"))
    return names.select("p_partkey", plain.alias("name"), X.creator_tag(plain).isNull().alias("untagged"))


def decisions(spark, sf_dir):
    """Planned removals of exact copies after someone declined those of longer documents."""
    docs = _documents(spark, sf_dir)
    planned = actions.duplicate_actions(_keepers(spark, sf_dir), "exact", "digest", "doc_id", "bytes")
    overrides = docs.where("n_chars > 1500").select(F.col("doc_id").cast("string").alias("src"), F.lit("skip").alias("decision"))
    return actions.decide(planned, overrides).select("src", "kind", "decision")


def log_lines(spark, sf_dir):
    """The text log of the planned removals of exact copies."""
    planned = actions.duplicate_actions(_keepers(spark, sf_dir), "exact", "digest", "doc_id", "bytes")
    told = events.action_events(planned, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return told.select(events.log_line(F.col("time"), F.col("level"), F.col("name"), F.col("message")).alias("line"))


_PLAN = f"""WITH RECURSIVE {_SIM}, {_DOCS},
k AS (SELECT *, count(*) OVER (PARTITION BY digest) AS n, row_number() OVER (PARTITION BY digest ORDER BY length(name), lower(name)) AS r FROM d WHERE digest IS NOT NULL),
left_over AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE r > 1)),
q AS (SELECT l.*, group_id, row_number() OVER (PARTITION BY group_id ORDER BY ceil(n_chars / {CHUNK}) DESC, n_chars * ceil(n_chars / {CHUNK}) DESC, bytes DESC, lower(name), name) AS r
  FROM left_over l JOIN g USING (doc_id)),
acts AS (SELECT 'exact' AS phase, digest AS group_id, CASE WHEN r = 1 THEN 'keep' ELSE 'trash' END AS kind, CAST(doc_id AS VARCHAR) AS src, bytes FROM k WHERE n > 1
  UNION ALL SELECT 'near', CAST(group_id AS VARCHAR), CASE WHEN r = 1 THEN 'keep' ELSE 'trash' END, CAST(doc_id AS VARCHAR), bytes FROM q)"""


def queries() -> dict:
    names = [
        exact_groups, exact_keeper, exact_survivors, work_digest, page_sample, page_hash, signature, pair_distance, pair_distance_gated,
        near_works, near_groups, near_keeper, std_name, episode_parse, episode_runs, merge_names, creator_tags, classify_scores, classify_suggest,
        index_hits, index_upsert, index_prune, archive_inventory, natural_order, unique_names, size_format, page_budget, plan_actions, run_report,
        works_inventory, page_order, file_prints, keeper_choice, standardise_plan, merge_plan, suggestion_order, tag_split, decisions, log_lines,
        index_remove, index_metadata, signature_hits, trash_names,
    ]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    number = "number"
    return {
        "exact_groups": f"WITH {_DOCS}, g AS (SELECT digest, count(*) AS n, min(doc_id) AS first_id FROM d WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) > 1) SELECT digest, n, first_id, doc_id FROM g JOIN d USING (digest)",
        "exact_keeper": f"{_KEEP} SELECT digest, doc_id, n, is_keeper FROM g WHERE n > 1",
        "exact_survivors": f"{_KEEP} SELECT doc_id, digest FROM d WHERE doc_id NOT IN (SELECT doc_id FROM g WHERE NOT is_keeper)",
        "work_digest": """WITH p AS (SELECT conv_id, turn, lower(CAST(turn AS VARCHAR) || '_' || role || '.TXT') AS name, text FROM conversations)
SELECT conv_id, count(*) AS n_pages, CASE WHEN count(text) = count(*) THEN sha256(string_agg(name || sha256(text), '' ORDER BY turn, name)) END AS digest,
  sha256(string_agg(name || ':' || CAST(strlen(text) AS VARCHAR) || ':' || CAST(turn AS VARCHAR), chr(10) ORDER BY turn, name)) AS fingerprint FROM p GROUP BY conv_id""",
        "page_sample": f"WITH p AS (SELECT doc_id, CAST(ceil(n_chars / {CHUNK}) AS BIGINT) AS pages FROM documents) SELECT doc_id, pages, {_sample_sql(12)} AS twelve, {_sample_sql(3)} AS three, {_sample_sql(1)} AS one FROM p",
        "page_hash": f"WITH {_HASH} SELECT vec_id, printf('%016x', hash) AS hex, CAST(bit_count(hash) AS INTEGER) AS ones, printf('%016x', hash) AS back FROM h",
        "signature": f"WITH {_SIG} SELECT ord, pages, array_to_string(list_transform(signature, lambda x: printf('%016x', x)), ',') AS signature FROM s",
        "pair_distance": f"WITH {_pairs_sql('TRUE')} SELECT ord_a, ord_b, round(distance, 9) AS distance, round(good_ratio, 9) AS good_ratio FROM pair",
        "pair_distance_gated": f"WITH {_pairs_sql(_GATE)} SELECT ord_a, ord_b, round(distance, 9) AS distance, round(good_ratio, 9) AS good_ratio FROM pair",
        "near_works": f"""WITH RECURSIVE {_pairs_sql(_GATE)},
np AS (SELECT ord_a AS a, ord_b AS b FROM pair WHERE distance <= {EMBEDDING_THRESHOLD} OR good_ratio >= {EMBEDDING_RATIO}),
{_closure_sql("np")} SELECT node AS ord, min(seen) AS group_id FROM walk GROUP BY node""",
        "near_groups": f"WITH RECURSIVE {_SIM} SELECT doc_id, group_id FROM g",
        "near_keeper": f"""WITH RECURSIVE {_SIM}, {_DOCS},
q AS (SELECT doc_id, group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY ceil(n_chars / {CHUNK}) DESC, n_chars * ceil(n_chars / {CHUNK}) DESC, bytes DESC, lower(name), name) AS INTEGER) AS rank
  FROM d JOIN g USING (doc_id)) SELECT *, rank = 1 AS is_keeper FROM q""",
        "std_name": _STD_SQL,
        "episode_parse": f"WITH {_PARSED} SELECT p_partkey, episode_name, prefix, suffix, episode, printf('e%02d_%s', p_size, '001.jpg') AS page FROM e",
        "episode_runs": f"""WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS number, l_partkey, l_suppkey FROM lineitem),
{_RUNS.format(keys="l_orderkey", number=number, order="l_partkey, l_suppkey", table="l")} SELECT l_orderkey, start, "end", n FROM k""",
        "creator_tags": rf"""WITH {_NAMES}, l AS (SELECT *, regexp_extract(tagged, '^\s*(?:(?:{_ANY_TAG})\s*)*') AS run FROM n),
t AS (SELECT *, list_transform(regexp_extract_all(run, '{_ANY_TAG}'), lambda g: trim(g[2:-2])) AS tags, trim(substr(tagged, 1 + length(run))) AS rest FROM l),
u AS (SELECT *, CASE WHEN list_position(tags, '') > 0 THEN tags[:list_position(tags, '') - 1] ELSE tags END AS searched, CASE WHEN rest = '' THEN trim(tagged) ELSE rest END AS title FROM t)
SELECT p_partkey, list_filter(searched, lambda g: NOT regexp_matches(lower(g), '{"|".join(X.METADATA_MARKERS)}'))[1] AS creator, title, '[New] ' || title AS proposed FROM u""",
        "classify_scores": f"WITH {_SCORES} SELECT * FROM sc",
        "classify_suggest": _SUGGEST,
        "index_hits": f"""WITH {_INDEX} SELECT wk.doc_id, coalesce(ix.fp = wk.fingerprint AND ix.exact_hash IS NOT NULL, false) AS is_hit,
  CASE WHEN ix.fp = wk.fingerprint THEN ix.exact_hash END AS cached, coalesce(ix.fp = wk.fingerprint AND ix.page_count > 0, false) AS scan_hit FROM wk LEFT JOIN ix USING (doc_id)""",
        "index_upsert": f"""WITH {_INDEX} SELECT doc_id, coalesce(wk.fingerprint, ix.fp) AS quick_fingerprint, ix.exact_hash, ix.fp AS exact_fp,
  coalesce(CASE WHEN wk.page_count > 1000 THEN wk.page_count END, ix.page_count, 0) AS page_count FROM ix FULL JOIN wk USING (doc_id)""",
        "index_prune": f"""WITH {_INDEX}, kp AS (SELECT * FROM ix WHERE doc_id IN (SELECT doc_id FROM wk WHERE page_count > 1000))
SELECT (SELECT count(*) FROM ix) - (SELECT count(*) FROM kp) AS removed, (SELECT count(*) FROM kp) AS kept, (SELECT min(doc_id) FROM kp) AS first""",
        "archive_inventory": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
n AS (SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '[^/]*$') AS name, path FROM p),
x AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN lower(regexp_extract(name, '\.[^.]+$')) ELSE '' END AS suffix,
  name LIKE '.\_%' ESCAPE '\' OR lower(name) IN ('.ds_store', 'desktop.ini', 'thumbs.db', 'ehthumbs.db', 'ehthumbs_vista.db') OR contains(path, '/__MACOSX/') OR starts_with(path, '__MACOSX/') AS is_junk FROM n)
SELECT page_id, folder, name, suffix, suffix IN ('.cbz', '.cbr', '.zip', '.pdf', '.epub') AS is_archive,
  suffix IN ('.jpg', '.jpeg', '.png', '.webp', '.gif', '.bmp', '.tif', '.tiff') AND NOT is_junk AS is_page, is_junk FROM x""",
        "natural_order": f"""WITH {_DOCS} SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY regexp_extract(name, '^[^0-9]*'),
  CAST(regexp_extract(name, '[0-9]+') AS BIGINT), doc_id) AS INTEGER) AS place FROM d""",
        "unique_names": """WITH w AS (SELECT p_partkey, p_brand, 'size' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 11 = 0 THEN '__' || CAST(p_partkey % 4 + 1 AS VARCHAR) ELSE '' END AS name FROM part),
t AS (SELECT DISTINCT p_brand, unnest(['size7', 'size7__2', 'size7__4', 'size8__3', 'size9__02']) AS name FROM part),
u AS (SELECT * FROM t UNION SELECT p_brand, name FROM w),
k AS (SELECT w.*, row_number() OVER (PARTITION BY p_brand, name ORDER BY p_partkey) - CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.p_brand = w.p_brand AND t.name = w.name) THEN 0 ELSE 1 END AS k FROM w),
b AS (SELECT p_brand, name, max(k) + 20 AS most FROM k GROUP BY ALL),
n AS (SELECT p_brand, name, unnest(range(2, most + 2)) AS j FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY j) AS k FROM n
  WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.p_brand = n.p_brand AND u.name = n.name || '__' || CAST(n.j AS VARCHAR)))
SELECT p_partkey, CASE WHEN k.k = 0 THEN k.name ELSE k.name || '__' || CAST(f.j AS VARCHAR) END AS free_name
FROM k LEFT JOIN f ON f.p_brand = k.p_brand AND f.name = k.name AND f.k = k.k""",
        "size_format": f"WITH {_DOCS}, s AS (SELECT source, CAST(sum(bytes) AS BIGINT) AS bytes, max(bytes) AS largest FROM d GROUP BY source) SELECT source, bytes, {_format_sql('bytes')} AS total, {_format_sql('largest')} AS most, {_format_sql('(-largest)')} AS freed FROM s",
        "page_budget": f"""WITH {_DOCS}, b AS (SELECT doc_id, bytes, CASE WHEN bytes > 0 THEN least(greatest(2 * bytes, 1024), 4194) ELSE 4194 END AS budget FROM d)
SELECT doc_id, CAST(budget AS BIGINT) AS budget, round(CASE WHEN bytes <= 0 THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0.05 AS DOUBLE), least(CAST(1 AS DOUBLE), sqrt(CAST(budget AS DOUBLE) / (bytes * 3)) * CAST(0.95 AS DOUBLE))) END, 9) AS scale FROM b""",
        "merge_names": f"""WITH {_MERGED} SELECT p_brand, prefix, suffix, start, "end", n, merged_name FROM rk""",
        "plan_actions": f"{_PLAN} SELECT phase, group_id, kind, src, bytes FROM acts",
        "run_report": f"""{_PLAN}, t AS (SELECT count(*) FILTER (kind = 'trash' AND phase = 'exact') AS exact_removed, count(*) FILTER (kind = 'trash' AND phase = 'near') AS near_removed,
  CAST(coalesce(sum(bytes) FILTER (kind = 'trash'), 0) AS BIGINT) AS bytes_reclaimed FROM acts)
SELECT (SELECT count(*) FROM documents) AS discovered, t.*, (WITH {_STANDARD} SELECT count(*) FROM std WHERE needs OR name <> standard) AS standardised,
  (WITH {_MERGED} SELECT count(*) FROM rk) AS merged, (SELECT count(*) FROM ({_SUGGEST})) AS suggestions, exact_removed + near_removed AS total, {_format_sql('bytes_reclaimed')} AS reclaimed FROM t""",
        "works_inventory": f"""WITH {_TREE}
SELECT path, kind, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name, n_pages, size, needs_pages FROM al
WHERE NOT EXISTS (SELECT 1 FROM fo WHERE starts_with(al.path, fo.path || '/'))""",
        "page_order": f"WITH {_TREE} SELECT path, parent AS work, CAST(row_number() OVER (PARTITION BY parent ORDER BY page_id) - 1 AS INTEGER) AS page_no FROM pg",
        "file_prints": """SELECT page_id, sha256(html) AS digest, sha256('file:' || CAST(strlen(html) AS VARCHAR) || ':' || CAST(page_id AS VARCHAR)) AS file_print,
  sha256('dir:' || CAST(page_id AS VARCHAR)) AS folder_print FROM pages""",
        "keeper_choice": f"""WITH RECURSIVE {_SIM}, {_DOCS},
q AS (SELECT doc_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY ceil(n_chars / {CHUNK}) DESC, n_chars * ceil(n_chars / {CHUNK}) DESC, bytes DESC, lower(name), name) AS rank
  FROM d JOIN g USING (doc_id)) SELECT doc_id, group_id, rank = CASE WHEN group_id % 2 = 0 THEN 2 ELSE 1 END AS is_keeper FROM q""",
        "standardise_plan": f"""WITH {_STANDARD}
SELECT CASE WHEN needs THEN 'convert' ELSE 'rename' END AS kind, CAST(p_partkey AS VARCHAR) AS src, standard AS dst FROM std WHERE needs OR name <> standard""",
        "merge_plan": f"""WITH {_MERGED} SELECT place, CAST(r.p_partkey AS VARCHAR) AS src, merged_name AS dst, r.episode FROM r JOIN rk USING (p_brand, prefix, suffix, run)""",
        "suggestion_order": f"""WITH sugg AS ({_SUGGEST})
SELECT vec_id, creator, confidence, CAST(row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, avg_distance, 'work ' || CAST(vec_id AS VARCHAR)) AS INTEGER) AS place,
  '[' || creator || '] work ' || CAST(vec_id AS VARCHAR) AS proposed FROM sugg""",
        "tag_split": f"""WITH {_NAMES} SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Vol. ' || CAST(p_size AS VARCHAR) || '.cbz' ELSE tagged END AS name, p_size % 3 = 0 AS untagged FROM n""",
        "decisions": f"""{_KEEP} SELECT CAST(doc_id AS VARCHAR) AS src, CASE WHEN is_keeper THEN 'keep' ELSE 'trash' END AS kind, CASE WHEN n_chars > 1500 THEN 'skip' ELSE 'accept' END AS decision FROM g WHERE n > 1""",
        "log_lines": f"""{_KEEP} SELECT '2024-05-06 07:08:09 [' || CASE WHEN is_keeper THEN 'INFO' ELSE 'WARNING' END || '] folioforge.exact: accept ' || CASE WHEN is_keeper THEN 'keep' ELSE 'trash' END
  || ' ' || CAST(doc_id AS VARCHAR) AS line FROM g WHERE n > 1""",
        "index_remove": f"""WITH {_INDEX} SELECT doc_id FROM ix WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 2000)""",
        "index_metadata": f"""WITH {_INDEX}, o AS (SELECT wk.doc_id, wk.fingerprint, wk.page_count AS n, ix.fp, ix.page_count AS m FROM wk LEFT JOIN ix USING (doc_id)),
h AS (SELECT *, coalesce(fp = fingerprint AND m > 0, false) AS is_hit FROM o)
SELECT doc_id, fingerprint AS quick_fingerprint, CASE WHEN is_hit THEN m WHEN doc_id % 3 = 0 THEN coalesce(m, 0) ELSE CASE WHEN n > 0 THEN n ELSE coalesce(m, 0) END END AS page_count,
  CASE WHEN is_hit THEN m % 7 WHEN doc_id % 3 = 0 THEN m % 7 ELSE n % 5 END AS width, CASE WHEN is_hit THEN m % 3 WHEN doc_id % 3 = 0 THEN m % 3 ELSE n % 11 END AS height, is_hit FROM h""",
        "signature_hits": f"""WITH {_SIG} SELECT ord, pages AS num_pages, pages = 12 AS is_hit FROM s""",
        "trash_names": f"""{_KEEP}, t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM g WHERE NOT is_keeper)
SELECT doc_id, 'copy' || CASE WHEN k = 0 THEN '' ELSE '__' || CAST(k AS VARCHAR) END AS place FROM t""",
    }
