"""Deterministic document views over the driver tables.

One SQL text per view; Spark binds the ``{names}`` to DataFrames, the oracle to common table
expressions, so both engines start from the same rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from folioframe.session import cut_lineage

VIEWS = {
    "fx_token": """
SELECT page_id, seq AS token_id, CAST(floor((seq - 1) / 8) AS BIGINT) AS line_id,
       CAST((seq % 8) * 70 + (l_partkey % 11) AS DOUBLE) AS x,
       CAST(floor((seq - 1) / 8) * 24 + (l_suppkey % 5) AS DOUBLE) AS y,
       CAST(24 + (l_partkey % 9) * 6 AS DOUBLE) AS w,
       CAST(12 + (l_suppkey % 4) AS DOUBLE) AS h,
       p_name AS text, lower(replace(p_name, ' ', '')) AS text_key, 40 + l_quantity AS conf,
       CASE WHEN l_partkey % 10 = 0 THEN 'pdf' ELSE 'ocr' END AS source, l_partkey, l_suppkey
FROM (SELECT l.*, p.p_name,
             CAST(floor(l_orderkey / 10) AS BIGINT) AS page_id,
             CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 10) AS BIGINT)
               ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                        l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS seq
      FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey) t""",
    "fx_token_b": """
SELECT page_id, token_id, line_id, x + (l_partkey % 5) - 2 AS x, y + (l_suppkey % 3) - 1 AS y, w, h,
       CASE WHEN l_partkey % 6 = 0 THEN concat(text, ' x') ELSE upper(text) END AS text,
       CASE WHEN l_partkey % 6 = 0 THEN concat(text_key, 'x') ELSE text_key END AS text_key,
       CAST(85 AS DOUBLE) AS conf
FROM {fx_token} WHERE (l_partkey + l_suppkey) % 7 <> 0""",
    "fx_reader": """
SELECT * FROM {fx_token} WHERE text NOT LIKE 'small%' AND text NOT LIKE 'hot%'""",
    "fx_local": """
SELECT page_id, token_id, line_id, x + 1 AS x, y AS y, w - 2 AS w, h, text, text_key,
       CAST(60 + (l_partkey % 40) AS DOUBLE) AS conf
FROM {fx_token} WHERE (l_partkey + token_id) % 4 <> 0""",
    "fx_page": """
SELECT page_id, CAST(600 AS DOUBLE) AS page_w, CAST(130 AS DOUBLE) AS page_h, count(*) AS words
FROM {fx_token} GROUP BY page_id""",
    "fx_cell": """
SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS page_id, o_orderkey % 10 AS cell_id, 'cell' AS kind,
       CAST((o_orderkey % 2) * 290 AS DOUBLE) AS x,
       CAST(floor((o_orderkey % 10) / 2) * 40 AS DOUBLE) AS y,
       CAST(290 AS DOUBLE) AS w, CAST(40 AS DOUBLE) AS h
FROM {orders} WHERE o_custkey % 9 <> 0""",
    "fx_grid": """
SELECT page_id, token_id AS cell_id, 'cell' AS kind, CAST((token_id % 8) * 70 AS DOUBLE) AS x,
       CAST(floor((token_id - 1) / 8) * 24 AS DOUBLE) AS y, CAST(70 AS DOUBLE) AS w, CAST(24 AS DOUBLE) AS h
FROM {fx_token} WHERE (l_partkey + token_id) % 9 <> 0""",
    "fx_word": """
SELECT *, text LIKE '%gear' OR text LIKE '%bolt' OR text LIKE '%ring' AS is_label, text LIKE '%gear' AS is_prompt,
       text LIKE '%gizmo' AS is_choice, text LIKE '%bolt' AS is_marker, text LIKE 'hot%' AS is_instruction
FROM {fx_token}""",
    "fx_header": """
SELECT DISTINCT p_name AS header_key, split_part(p_name, ' ', 1) AS label, 'text' AS type, p_name LIKE 'blue%' AS is_group
FROM {part} WHERE p_name LIKE 'red%' OR p_name LIKE 'blue%' OR p_name LIKE 'hot%'""",
    "fx_rect": """
SELECT page_id, cell_id AS rect_id, x, y, CASE WHEN cell_id % 5 = 0 THEN CAST(20 AS DOUBLE) ELSE w END AS w,
       CASE WHEN cell_id % 5 = 0 THEN CAST(20 AS DOUBLE) WHEN cell_id % 3 = 0 THEN CAST(70 AS DOUBLE) WHEN cell_id % 3 = 1 THEN CAST(12 AS DOUBLE) ELSE h END AS h,
       FALSE AS is_checkbox, FALSE AS is_graphic FROM {fx_cell}""",
    "fx_rule": """
SELECT page_id, (token_id % 8) * 100 + line_id AS line_id, x AS x1, y + h AS y, x + w + 20 AS x2, token_id % 17 = 0 AS is_vertical
FROM {fx_token}""",
    "fx_field": """
SELECT page_id, token_id AS field_id, x + 2 AS x, y + 1 AS y, w + 30 AS w, h + 4 AS h, text AS label,
       floor(conf + 0.5) / 100 AS confidence,
       CASE l_partkey % 3 WHEN 0 THEN 'TABLE_CELL' WHEN 1 THEN 'VECTOR_LINE' ELSE 'TEXT_ANCHOR' END AS derivation,
       CASE l_suppkey % 4 WHEN 0 THEN 'CHECKBOX' WHEN 1 THEN 'TEXT_LONG' ELSE 'TEXT_SHORT' END AS field_type
FROM {fx_token} WHERE token_id % 3 <> 0""",
    "fx_field_prev": """
SELECT page_id, token_id AS field_id, x, y, w + 28 AS w, h + 5 AS h, text AS label,
       CASE l_suppkey % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'MODIFIED'
                          WHEN 2 THEN 'REJECTED' ELSE 'PROPOSED' END AS calibration_status,
       CASE l_partkey % 13 WHEN 0 THEN 'ACROFORM' WHEN 1 THEN 'MANUAL' ELSE 'TABLE_CELL' END AS derivation
FROM {fx_token} WHERE token_id % 4 = 1""",
    "fx_line": """
SELECT page_id, token_id AS line_id, x AS x1, y + h AS y, x + w + 20 AS x2, token_id % 17 = 0 AS is_vertical
FROM {fx_token}""",
    "fx_doc_page": """
SELECT conv_id AS doc_id, turn + 1 AS page_no, text, role, CAST(80 + (turn % 20) AS DOUBLE) AS confidence
FROM {conversations}""",
    "fx_page_fp": """
SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS doc_key,
       CAST(595 + (page_id % 3) AS DOUBLE) AS page_width, CAST(842 AS DOUBLE) AS page_height,
       CASE WHEN page_id % 11 = 0 THEN 90 ELSE 0 END AS rotation,
       CAST((length(html) - length(replace(html, '<li>', ''))) / 4 AS BIGINT) AS vector_count,
       CAST((length(html) - length(replace(html, '<br', ''))) / 3 AS BIGINT) AS raster_count,
       CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT) AS text_count
FROM {pages}""",
    "fx_model": """
SELECT * FROM (VALUES ('M_EN','en','the'),('M_EN','en','and'),('M_EN','en','that'),
                      ('M_DE','de','der'),('M_DE','de','und'),('M_DE','de','ung'),
                      ('M_FR','fr','pour'),('M_FR','fr','dans'),('M_FR','fr','que'),
                      ('M_ES','es','los'),('M_ES','es','para'),('M_ES','es','que'))
  AS t(model_id, family, token)""",
    "fx_registry": """
SELECT s_suppkey AS template_id, s_name AS name, n_name AS school_order,
       2018 + (s_suppkey % 7) AS validity_year,
       CASE s_suppkey % 4 WHEN 0 THEN 'archived' WHEN 1 THEN 'deprecated' ELSE 'active' END AS status,
       s_suppkey % 6 AS fingerprint
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
}

_NAME = re.compile(r"\{(\w+)\}")


class Fixtures:
    """The views and driver tables of one scale-factor directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.written = spark, sf_dir, {}

    def shared(self, name: str) -> Fixtures:
        """The same views over one written copy of ``name``: for queries with several views derived from it."""
        other = Fixtures(self.spark, self.sf_dir)
        other.written = self.written | {name: cut_lineage(self[name])}
        return other

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.written:
            return self.written[name]
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name]
        return self.spark.sql(text, **{n: self[n] for n in dict.fromkeys(_NAME.findall(text))})

    def stored(self, name: str) -> DataFrame:
        """A view written once, as page tables are on a cluster: for operators that read it many times."""
        return cut_lineage(self[name])

    def __getattr__(self, name: str) -> DataFrame:
        return self[name if not name.startswith("fx") else name]


@lru_cache(maxsize=None)
def _needs(name: str) -> tuple[str, ...]:
    direct = [n for n in dict.fromkeys(_NAME.findall(VIEWS[name])) if n in VIEWS]
    ordered: list[str] = []
    for n in direct:
        ordered += [m for m in (*_needs(n), n) if m not in ordered]
    return tuple(ordered)


def oracle_query(body: str) -> str:
    """SQL for the oracle: ``body`` with every ``{view}`` it names supplied in front.

    ``body`` is a SELECT, optionally preceded by its own ``WITH`` list.
    """
    used: list[str] = []
    for name in dict.fromkeys(_NAME.findall(body)):
        if name in VIEWS:
            used += [m for m in (*_needs(name), name) if m not in used]
    bare = lambda text: _NAME.sub(r"\1", text)
    ctes = [f"{n} AS ({bare(VIEWS[n])}\n)" for n in used]
    text = bare(body).strip()
    recursive = text.upper().startswith("WITH RECURSIVE")
    if text.upper().startswith("WITH"):
        own, text = text.split(None, 2 if recursive else 1)[-1], ""
        ctes.append(own)
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + text
