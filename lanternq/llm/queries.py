"""Queries of this package: name -> (spark, directory) -> DataFrame, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import encodings, leaks, lookalikes, main_text, mixing, near_copies, sentences, site_lines, terms

Query = Callable[[SparkSession, str], DataFrame]
NORM = ["title_norm", "text_norm"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.wrong_lines(table(spark, d, "documents")).select("doc_id", "field").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return encodings.restored(docs, encodings.wrong_lines(docs))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.expanded(*near_copies.near_copies(table(spark, d, "documents"))).toDF("doc_id_a", "doc_id_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every document that has a copy, with the group's id and its number of links between representatives."""
    return near_copies.groups(*near_copies.near_copies(table(spark, d, "documents"))).toDF("doc_id", "class_id", "links")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs between the representatives of equal texts; p2_members says whom they stand for."""
    pairs, _ = near_copies.near_copies(table(spark, d, "documents"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), F.round("jaccard", 6).alias("jaccard"))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """Every document of equal text with another, and the one that stands for it."""
    _, members = near_copies.near_copies(table(spark, d, "documents"))
    return members.toDF("doc_id", "representative")


_fitted: dict[tuple[str, str], str] = {}


def _labeller(spark: SparkSession, d: str) -> DataFrame:
    """The labeller of a directory's pages, fitted once an application and kept in the shared folder as long as that is."""
    at = spark.sparkContext.applicationId, d
    try:
        return spark.read.parquet(_fitted[at])
    except (KeyError, AnalysisException):
        fitted = main_text.trained(table(spark, d, "documents"))
        _fitted[at] = fitted.inputFiles()[0].rpartition("/")[0]
        return fitted


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return main_text.outside_lines(table(spark, d, "documents"), fitted=_labeller(spark, d))


def p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return site_lines.without_lines(docs, main_text.outside_lines(docs, fitted=_labeller(spark, d)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "documents")).select("doc_id", "line_no")


def p4_clean_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return site_lines.without_lines(docs, site_lines.repeated_lines(docs))


def p4_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates that stand in many documents of a site, lines with changing names among them."""
    return site_lines.templates(table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_term_frequencies(spark, d).filter("mark is not null").select("term", "mark")


def p5_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "indexed_documents"), NORM)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of positive relevance weight that reach the bound of the problem's own rule."""
    scored = terms.distinctive_terms(table(spark, d, "indexed_documents"), "document_id", NORM, least=3, records_between=(2, 20))
    weight = F.col("n") / F.col("length") * F.log(F.col("rows") / F.col("records"))
    return scored.filter((F.col("score") > 0) & (weight >= 0.05)).select("document_id", "term")


def p6_term_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = terms.distinctive_terms(table(spark, d, "indexed_documents"), "document_id", NORM)
    return scored.select("document_id", "term", "n", "records", F.round("score", 6).alias("score"))


def _forms(spark: SparkSession, d: str, every: bool) -> DataFrame:
    one = lookalikes.inconsistent(table(spark, d, "documents"), "doc_id", "text", every).withColumn("field", F.lit("text"))
    two = lookalikes.inconsistent(table(spark, d, "indexed_documents"), "document_id", "text_norm", every).withColumnRenamed("document_id", "doc_id").withColumn("field", F.lit("text_norm"))
    return one.unionByName(two)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that differ from their form by one of the faults; documents decoded wrongly are left to problem 1."""
    wrong = encodings.wrong_lines(table(spark, d, "documents")).filter("field = 'text'").select("doc_id").distinct()
    return _forms(spark, d, False).join(wrong, "doc_id", "left_anti").select("doc_id", "field")


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every value, with or without a fault, so that equal looks compare equal."""
    return _forms(spark, d, True)


#: Edits within which a passage counts as found; p8_found then keeps the unbroken runs.
EDITS = 1


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"), edits=EDITS)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).filter("run * 2 >= item_length").select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that hold half of it, within an edit and unbroken, and the longest parts."""
    whole = F.when(F.col("run") * 2 >= F.col("item_length"), F.col("doc_id"))
    found = _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents_within_edits"), F.countDistinct(whole).alias("documents"), F.max("run").alias("longest_run"), F.max("part").alias("longest_part"))
    return table(spark, d, "benchmark").select("item_id").join(found, "item_id", "left").fillna(0, ["documents_within_edits", "documents", "longest_run", "longest_part"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the mixture holds all that the cap allows, and still less than the target."""
    return p9_shares(spark, d).filter("reached = tokens * max_repeats and reached < target_share * total").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The report: what each source was to give and gave."""
    _, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.select("source", "target_share", "max_repeats", "total", "tokens", "documents", "copies", "short", "reached", F.round("reached_share", 6).alias("reached_share"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    mixture, _ = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixture


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = sentences.of_chosen(table(spark, d, "documents"), table(spark, d, "sentence_docs"))
    return sentences.sentences(docs, with_text=False).select("doc_id", "start_pos", "end_pos")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every document, not only the judged ones, with the sentences themselves."""
    return sentences.sentences(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


#: Terms a second time, by windows over characters.
TERMS = """WITH fld AS (SELECT row_number() OVER () AS row, document_id, coalesce(title_norm, '') AS t, coalesce(text_norm, '') AS x FROM indexed_documents),
arr AS (SELECT row, document_id, regexp_extract_all(t || chr(10) || x, '(?s).') AS a FROM fld),
ch AS (SELECT row, document_id, unnest(a) AS c, generate_subscripts(a, 1) AS p FROM arr),
k AS (SELECT *, CASE WHEN unicode(c) BETWEEN 19968 AND 40959 THEN 1 WHEN regexp_matches(c, '[\\p{L}\\p{M}\\p{N}]') THEN 2 ELSE 0 END AS kind FROM ch),
nb AS (SELECT *, lead(c) OVER w AS c2, coalesce(lead(kind) OVER w, 0) AS k2, coalesce(lag(kind) OVER w, 0) AS k0 FROM k WINDOW w AS (PARTITION BY row ORDER BY p)),
runs AS (SELECT *, sum(CASE WHEN k0 <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY p) AS r FROM nb WHERE kind = 2),
tok AS (SELECT row, document_id, c || c2 AS term FROM nb WHERE kind = 1 AND k2 = 1
  UNION ALL SELECT row, document_id, c FROM nb WHERE kind = 1 AND k2 <> 1 AND k0 <> 1
  UNION ALL SELECT row, document_id, string_agg(c, '' ORDER BY p) FROM runs GROUP BY row, document_id, r),
per AS (SELECT row, document_id, term, count(*) AS n FROM tok GROUP BY 1, 2, 3),
size AS (SELECT row, sum(n) AS length FROM per GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM indexed_documents) AS rows, (SELECT sum(n) FROM per) AS tokens),
freq AS (SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) AS records, CASE WHEN sum(n) <= 2 THEN 'rare' WHEN count(*) >= 0.2e0 * any_value(rows) THEN 'common' END AS mark FROM per CROSS JOIN st GROUP BY 1),
sc AS (SELECT per.*, records, rows, CAST(length AS BIGINT) AS length, ln(1e0 + (rows - records + 0.5e0) / (records + 0.5e0)) * n * 2.2e0 / (n + 1.2e0 * (0.25e0 + 0.75e0 * length / (CAST(tokens AS DOUBLE) / rows))) AS score FROM per JOIN freq USING (term) JOIN size USING (row) CROSS JOIN st) """
#: Lines of each site by their form.
LINES = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_replace(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^(www|m)\.', '') AS site, text FROM documents),
base AS (SELECT site, count(*) AS n_of FROM d WHERE site <> '' GROUP BY 1),
l AS (SELECT row, doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d WHERE site <> ''),
f AS (SELECT *, regexp_replace(trim(regexp_replace(line, '[ \t\x{00A0}\x{3000}]+', ' ', 'g'), ' '), '[0-9]+', '#', 'g') AS form FROM l WHERE regexp_matches(line, '[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')),
many AS (SELECT site, form FROM f JOIN base USING (site) GROUP BY site, form, n_of HAVING count(DISTINCT row) >= 6 AND count(DISTINCT row) * 20 >= n_of),
found AS (SELECT row, doc_id, line_no FROM f JOIN many USING (site, form)) """
#: Similar pairs, by all shared substrings of five signs; classes of equal stripped texts; groups by what can be reached.
COPIES = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(coalesce(title, '') || coalesce(text, ''), '[ \n\x{00A0}\x{3000}]', '', 'g') AS s FROM documents),
a AS (SELECT doc_id, regexp_extract_all(s, '(?s).') AS c FROM t WHERE length(s) >= 5),
g AS (SELECT DISTINCT doc_id, unnest([array_to_string(c[i:i + 4], '') FOR i IN range(1, len(c) - 3)]) AS h FROM a),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
sh AS (SELECT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b, count(*) AS shared FROM g x JOIN g y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
p AS (SELECT doc_id_a, doc_id_b, shared / CAST(na.n + nb.n - shared AS DOUBLE) AS jaccard FROM sh JOIN n na ON na.doc_id = doc_id_a JOIN n nb ON nb.doc_id = doc_id_b WHERE shared >= 0.6e0 * (na.n + nb.n - shared)),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS representative FROM t WHERE length(s) >= 5),
rp AS (SELECT p.* FROM p JOIN m x ON x.doc_id = doc_id_a AND x.representative = doc_id_a JOIN m y ON y.doc_id = doc_id_b AND y.representative = doc_id_b),
e AS (SELECT doc_id_a AS a, doc_id_b AS b FROM rp UNION ALL SELECT representative, doc_id FROM m WHERE doc_id <> representative),
ee AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc_id, a AS node FROM ee UNION SELECT r.doc_id, ee.b FROM r JOIN ee ON ee.a = r.node) """
SIZES = r"""WITH s AS (SELECT source, CASE WHEN text IS NULL THEN 0 ELSE length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) + (length(text) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) + 3) // 4 END AS tokens FROM documents),
p AS (SELECT m.source, target_share, max_repeats, coalesce(sum(tokens), 0) AS tokens FROM mix_targets m LEFT JOIN s USING (source) GROUP BY 1, 2, 3) """
#: The whole draw a second time, by plain windows: sizes, plan, inclusion, ranks.
DRAW = (
    SIZES.replace("SELECT source, CASE", "SELECT doc_id, source, CASE")
    + """, t AS (SELECT sum(tokens) AS total FROM (SELECT DISTINCT source, tokens FROM p)),
a AS (SELECT source, target_share, max_repeats, CAST(total AS BIGINT) AS total, CAST(tokens AS BIGINT) AS tokens, least(target_share * total, CAST(tokens * max_repeats AS DOUBLE)) AS used, tokens * max_repeats < target_share * total AS short FROM p CROSS JOIN t),
b AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(used / tokens) AS INTEGER) ELSE 0 END AS whole FROM a),
r AS (SELECT *, used - whole * tokens AS rest FROM b),
h AS (SELECT s.source, s.tokens, count(*) AS docs, any_value(rest) AS rest FROM s JOIN r USING (source) WHERE s.tokens > 0 AND rest > 0 GROUP BY 1, 2),
h2 AS (SELECT *, coalesce(sum(docs * tokens) OVER (PARTITION BY source ORDER BY tokens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(docs * CAST(tokens AS DOUBLE) * tokens) OVER (PARTITION BY source ORDER BY tokens DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS squares FROM h),
h3 AS (SELECT *, (rest - held) / squares AS c FROM h2),
o AS (SELECT source, coalesce(max(CASE WHEN rest > held AND c * tokens <= 1 THEN tokens END), 0) AS largest FROM h3 GROUP BY 1),
oc AS (SELECT h3.source, largest, coalesce(max(CASE WHEN h3.tokens = largest THEN c END), 0) AS c FROM h3 JOIN o USING (source) GROUP BY 1, 2),
sz AS (SELECT oc.source, largest, oc.c, CAST(round(sum(docs * CASE WHEN tokens > largest THEN 1e0 ELSE least(1e0, oc.c * tokens) END)) AS BIGINT) AS n FROM h3 JOIN oc USING (source) GROUP BY 1, 2, 3),
u AS (SELECT doc_id, s.source, s.tokens, n, CASE WHEN s.tokens > largest THEN 1e0 ELSE least(1e0, c * s.tokens) END AS pr, (CAST('0x' || substr(md5('1:' || doc_id), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0 AS x FROM s JOIN sz USING (source) WHERE s.tokens > 0),
q AS (SELECT *, CASE WHEN pr >= 1 THEN 0e0 ELSE (x / (1 - x)) / (pr / (1 - pr)) / (1 + (x / (1 - x)) / (pr / (1 - pr))) END AS q FROM u),
drawn AS (SELECT doc_id, source FROM q QUALIFY row_number() OVER (PARTITION BY source ORDER BY q, doc_id) <= n),
mixed AS (SELECT s.doc_id, s.source, CAST(s.tokens AS BIGINT) AS tokens, whole + CASE WHEN d.doc_id IS NULL THEN 0 ELSE 1 END AS copies FROM s JOIN r USING (source) LEFT JOIN drawn d ON d.doc_id = s.doc_id),
mixture AS (SELECT * FROM mixed WHERE copies > 0),
got AS (SELECT source, CAST(sum(tokens * copies) AS BIGINT) AS reached FROM mixture GROUP BY 1) """
)


def oracle_sql() -> dict[str, str]:
    """SQL twins; the other queries are tested against brute force, round trips or held-out labels."""
    return {
        "p2_found": COPIES + "SELECT doc_id_a, doc_id_b FROM p",
        "p2_pairs": COPIES + "SELECT doc_id_a, doc_id_b, round(jaccard, 6) AS jaccard FROM rp",
        "p2_members": COPIES + "SELECT doc_id, representative FROM m WHERE doc_id <> representative",
        "p2_groups": COPIES + "SELECT r.doc_id, min(node) AS class_id, (SELECT count(*) FROM ee WHERE ee.a = r.doc_id) AS links FROM r GROUP BY r.doc_id",
        "p4_found": LINES + "SELECT doc_id, line_no FROM found",
        "p4_clean_text": LINES + "SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(x, chr(10) ORDER BY i) FROM (SELECT unnest(string_split(d.text, chr(10))) AS x, generate_subscripts(string_split(d.text, chr(10)), 1) AS i) WHERE i NOT IN (SELECT line_no FROM found WHERE found.row = d.row)), '') END AS text FROM d",
        "p5_found": TERMS + "SELECT term, mark FROM freq WHERE mark IS NOT NULL",
        "p5_term_frequencies": TERMS + "SELECT term, total, records, mark FROM freq",
        "p6_found": TERMS + "SELECT document_id, term FROM sc WHERE n >= 3 AND records BETWEEN 2 AND 20 AND n / CAST(length AS DOUBLE) * ln(rows / CAST(records AS DOUBLE)) >= 0.05e0",
        "p6_term_scores": TERMS + "SELECT document_id, term, n, records, round(score, 6) AS score FROM sc",
        "p9_mixture": DRAW + "SELECT doc_id, source, tokens, copies FROM mixture",
        "p9_shares": DRAW + "SELECT r.source, target_share, max_repeats, total, r.tokens, (SELECT count(*) FROM documents d WHERE d.source = r.source) AS documents, whole AS copies, short, coalesce(reached, 0) AS reached, round(coalesce(reached, 0) / CAST((SELECT sum(reached) FROM got) AS DOUBLE), 6) AS reached_share FROM r LEFT JOIN got USING (source)",
        "p9_found": SIZES + "SELECT source FROM p WHERE tokens * max_repeats < target_share * (SELECT sum(tokens) FROM (SELECT DISTINCT source, tokens FROM p))",
    }
