"""A vault of linked notes made from ``documents``: one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _pad(expr: str) -> str:
    return f"lpad(cast({expr} as varchar(20)), 6, '0')"


_N = "(select count(*) from documents)"
VAULT_SQL = f"""
select doc_id, source, text,
  case doc_id % 10 when 3 then 'Doc_' || {_pad('doc_id - 1')} when 5 then 'Doc  ' || {_pad('doc_id')} || '!' else 'doc-' || {_pad('doc_id')} end as stem,
  (case when doc_id % 11 = 0 then '' when doc_id % 11 = 1 then 'Tags:' || chr(10)
     else 'Tags: [[doc-' || {_pad(f'(doc_id * 7 + 3) % {_N}')} || ']] [[Doc ' || {_pad(f'(doc_id * 13 + 1) % {_N}')} || ']] [[doc-' || {_pad(f'{_N} + doc_id')} || '|Doc ' || {_pad(f'(doc_id * 3 + 2) % {_N}')} || ']]' || chr(10) end)
  || '# Note ' || cast(doc_id as varchar(20)) || chr(10) || chr(10)
  || (case doc_id % 17 when 0 then '- ' || replace(text, chr(10), chr(10) || '- ') when 1 then 'Meeting TODO ' || text else replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) end) || chr(10)
  || (case when doc_id % 3 = 0 then chr(10) || '# See Also' || chr(10) || '- [[doc-' || {_pad(f'(doc_id * 5 + 2) % {_N}')} || ']]' || chr(10) || '- [[Doc ' || {_pad(f'(doc_id + 1) % {_N}')} || ']]' || chr(10) else '' end)
  || chr(10) || '# References' || chr(10) || '1. [[' || source || ']]' || chr(10)
  || (case doc_id % 4 when 0 then chr(10) || 'Status: #processed' when 1 then chr(10) || '#processed' when 2 then chr(10) || 'Status: #draft' else '' end) as content
from (select doc_id, source, coalesce(text, '') as text from documents)
"""


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, stem, content)."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(VAULT_SQL.replace("from documents", "from {documents}"), documents=documents)
