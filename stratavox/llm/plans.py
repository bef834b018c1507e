"""Queries of the training-data problems (1, 5, 7, 8, 9) over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

import os
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import current_cells
from ..operators.measures import MEASURES as RANGES
from ..session import Stash
from ..sources.tables import spread, table
from .cutoffs import keep_fraction
from .leaks import leaked_passages
from .lookalikes import ANY_CASE, CYRILLIC, GREEK, consistent_text, look_alike_pairs, look_classes
from .packing import container_report, pack_documents, packing_violations, token_counts
from .quantiles import daily, merge_sketches, percentiles, rank_check, sketches

#: Where the public vocabulary lies; the file is a parameter of the operator.
VOCABULARY = os.environ.get("STRATAVOX_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
DOMAIN = {name: limits for name, limits in RANGES.items() if limits}
MEASURES = ["center_intensity", "r_xy", "r_z"]


def _keep(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cells = current_cells(table(spark, folder, "cells", "cell_ord", "image_name", "channel", "det_no", "loaded_at", "center_intensity", "r_xy_max_std"))
    low, high = DOMAIN["r_xy_max_std"]
    inside = (F.col("r_xy_max_std") > low) & (F.col("r_xy_max_std") < high)
    both = F.array(
        F.struct(F.lit("center_intensity").alias("measure"), F.col("center_intensity").alias("value")),
        F.struct(F.lit("r_xy_max_std").alias("measure"), F.when(inside, F.col("r_xy_max_std")).alias("value")),
    )
    records = cells.select("image_name", F.col("cell_ord").alias("row_id"), F.inline(both)).filter(F.col("value").isNotNull())
    return keep_fraction(records, table(spark, folder, "keep_targets"), ["image_name", "measure"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _keep(spark, folder)[1].select("measure", F.col("row_id").alias("cell_ord"))


def p1_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return _keep(spark, folder)[0]


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    return current_cells(table(spark, folder, "cells", "cell_ord", "image_name", "channel", "det_no", "loaded_at", "detected_at", *MEASURES))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["image_name", "channel"]
    found = percentiles(sketches(_measured(spark, folder), keys, MEASURES, DOMAIN), keys, [50, 95])
    m = F.col("measure")
    over = ((m == "center_intensity") & (F.col("p50") > 1000)) | ((m == "r_xy") & (F.col("p95") > 9)) | ((m == "r_z") & (F.col("p95") > 14))
    return found.filter(over).select(*keys, "measure")


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["image_name", "channel"]
    return percentiles(sketches(_measured(spark, folder), keys, MEASURES, DOMAIN), keys, [50, 90, 95, 99, 99.9])


def p5_daily(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["image_name", "channel", "day"]
    return percentiles(sketches(daily(_measured(spark, folder), "detected_at"), keys, MEASURES, DOMAIN), keys, [50, 95, 99])


def p5_within_bound(spark: SparkSession, folder: str) -> DataFrame:
    """Each percentile per image and channel, from the combined sketches of its days, against exact ranks."""
    keys, percents = ["image_name", "channel"], [1, 50, 95, 99]
    cells = Stash(_measured(spark, folder), "current").df
    days = sketches(daily(cells, "detected_at"), [*keys, "day"], MEASURES, DOMAIN)
    found = percentiles(merge_sketches(days, keys), keys, percents, bounds=True)
    return rank_check(cells, found, keys, percents, DOMAIN)


def p5_days_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per channel from the sketches of images and days alone."""
    days = sketches(daily(_measured(spark, folder), "detected_at"), ["image_name", "channel", "day"], MEASURES, DOMAIN)
    return percentiles(merge_sketches(days, ["channel"]), ["channel"], [50, 95, 99])


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents", "doc_id", "text"))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Token counts, written once as their number, the placement and its check read them, and the placement."""
    counts = Stash(token_counts(_documents(spark, folder), "doc_id", "text", VOCABULARY), "tokens", {"n": F.count("*")})
    return counts.df, pack_documents(counts.df, n_docs=counts.seen["n"])


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)[1].withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return container_report(_packed(spark, folder)[1])


def p7_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that the placement breaks; none are expected."""
    counts, placed = _packed(spark, folder)
    return packing_violations(Stash(placed, "placed").df, counts)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(_documents(spark, folder), table(spark, folder, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).filter("n_exact > 0").select("item_id", "doc_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = look_alike_pairs(_documents(spark, folder), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    return look_classes(_documents(spark, folder), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", consistent_text("text").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_cutoffs, p5_found, p5_percentiles, p5_daily, p5_days_combined, p5_within_bound, p7_containers, p7_report, p7_violations, p8_found, p8_leaks, p9_found, p9_classes, p9_texts)
}

#: DuckDB may answer isnan() from Parquet statistics, which leave NaN out; the SQL compares the text instead.
_CURRENT = """current_cells AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_name, channel, det_no
  ORDER BY loaded_at DESC NULLS LAST, cell_ord DESC) AS rn FROM cells) WHERE rn = 1)"""

_RANKED = f"""WITH {_CURRENT},
  records AS (SELECT image_name, 'center_intensity' AS measure, cell_ord, center_intensity AS value FROM current_cells WHERE CAST(center_intensity AS VARCHAR) <> 'nan'
    UNION ALL SELECT image_name, 'r_xy_max_std', cell_ord, r_xy_max_std FROM current_cells WHERE CAST(r_xy_max_std AS VARCHAR) <> 'nan' AND r_xy_max_std > 1e-9 AND r_xy_max_std < 100),
  signed AS (SELECT t.image_name, t.measure, t.keep_side, t.keep_permille, r.cell_ord, CASE WHEN t.keep_side = 'high' THEN -r.value ELSE r.value END AS v
    FROM keep_targets t JOIN records r USING (image_name, measure)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY image_name, measure ORDER BY v) AS nth, count(*) OVER (PARTITION BY image_name, measure) AS n FROM signed),
  cut AS (SELECT image_name, measure, any_value(n) AS n, any_value((keep_permille * n + 999) // 1000) AS k, max(v) AS v FROM ranked WHERE nth <= (keep_permille * n + 999) // 1000 GROUP BY ALL)"""

_SHARE = """SELECT image_name, channel, '{0}' AS measure FROM current_cells WHERE CAST({0} AS VARCHAR) <> 'nan' {1} GROUP BY image_name, channel
  HAVING quantile_disc({0}, {2}) > {3}"""
_RANGE = "AND {0} > 1e-9 AND {0} < 10000"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_ALIKE = "".join({**CYRILLIC, **GREEK}), "".join({**CYRILLIC, **GREEK}.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: A text with invisible characters removed, and width, blanks and look-alike letters levelled.
_IGNORED = r"[\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
_LEVELLED = f"regexp_replace(regexp_replace(@, '{_IGNORED}', '', 'g'), '" + r"[\t\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]" + "', ' ', 'g')"
for _old, _new in [*zip(*_WIDE), *zip(*_ALIKE)]:
    _LEVELLED = f"replace({_LEVELLED}, '{_old}', {_quoted(_new)})"
#: The comparison form: levelled, without case, in plain letters for look-alikes of either case and for compatibility characters of the first block.
_COMPARED = "replace(replace(lower(" + _LEVELLED + "), 'ß', 'ss'), 'ς', 'σ')"
for _old, _new in {**{k: v for k, v in ANY_CASE.items() if k == k.lower()}, **{chr(c): unicodedata.normalize("NFKD", chr(c)).lower() for c in range(0xA1, 0x100) if unicodedata.decomposition(chr(c)).startswith("<")}}.items():
    _COMPARED = f"replace({_COMPARED}, '{_old}', {_quoted(_new.lower())})"
_COMPARED = f"translate({_COMPARED}, chr(9) || chr(11) || chr(12) || chr(13), ' ' || chr(10) || chr(10) || chr(10))"
_WORDS = "regexp_extract_all(lower(strip_accents(" + _LEVELLED + ")), '[\\p{L}\\p{N}]+')"

SQL = {
    "p8_found": f"""WITH item AS (SELECT item_id, {_WORDS.replace("@", "text")} AS w FROM eval_items WHERE text IS NOT NULL),
      doc AS (SELECT doc_id, {_WORDS.replace("@", "text")} AS w FROM documents WHERE text IS NOT NULL),
      passage AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM item)),
      place AS (SELECT doc_id, array_to_string(w[k : k + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM doc))
      SELECT DISTINCT item_id, doc_id FROM place JOIN passage USING (p)""",
    "p9_found": f"""WITH k AS (SELECT doc_id, text, nfc_normalize({_LEVELLED.replace("@", "text")}) AS shown FROM documents)
      SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.shown = b.shown AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_texts": f"""SELECT doc_id, nfc_normalize({_COMPARED.replace("@", "text")}) AS text FROM documents""",
    "p9_classes": f"""WITH k AS (SELECT doc_id, text, coalesce(nfc_normalize({_COMPARED.replace("@", "text")}), 'null ' || doc_id) AS c FROM documents),
      d AS (SELECT c, min(doc_id) AS class_id, count(*) AS n_docs, count(DISTINCT text) AS n_texts FROM k GROUP BY c)
      SELECT k.doc_id, d.class_id, d.n_docs, greatest(d.n_texts, 1) AS n_texts FROM k JOIN d USING (c)""",
    "p1_found": f"{_RANKED} SELECT s.measure, s.cell_ord FROM signed s JOIN cut c USING (image_name, measure) WHERE s.v <= c.v",
    "p1_cutoffs": f"""{_RANKED}, kept AS (SELECT image_name, measure, count(*) AS n_kept FROM signed s JOIN cut c USING (image_name, measure) WHERE s.v <= c.v GROUP BY ALL),
      sized AS (SELECT image_name, measure, count(*) AS n FROM signed GROUP BY ALL)
      SELECT t.image_name, t.measure, t.keep_side, t.keep_permille, coalesce(s.n, 0) AS n, coalesce(c.k, 0) AS k, CASE WHEN t.keep_side = 'high' THEN -c.v ELSE c.v END AS cutoff,
        coalesce(q.n_kept, 0) AS n_kept FROM keep_targets t LEFT JOIN sized s USING (image_name, measure) LEFT JOIN cut c USING (image_name, measure) LEFT JOIN kept q USING (image_name, measure)""",
    "p5_within_bound": f"""WITH {_CURRENT}, sized AS ({" UNION ALL ".join(f"SELECT image_name, channel, '{m}' AS measure, count(*) AS n_values FROM current_cells WHERE CAST({m} AS VARCHAR) <> 'nan' {_RANGE.format(m) if m in DOMAIN else ''} GROUP BY image_name, channel" for m in MEASURES)})
      SELECT image_name, channel, measure, n_values, unnest([1.0, 50.0, 95.0, 99.0])::DOUBLE AS percent, true AS within FROM sized""",
    "p5_found": f"WITH {_CURRENT} "
    + " UNION ALL ".join(
        [_SHARE.format("center_intensity", "", 0.5, 1000), _SHARE.format("r_xy", _RANGE.format("r_xy"), 0.95, 9), _SHARE.format("r_z", _RANGE.format("r_z"), 0.95, 14)]
    ),
}
