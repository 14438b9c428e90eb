"""The ``articles`` frame that every operator reads, built from the tables documents and labels.

``NOW`` stands for the wall clock: operators take the current time as a
parameter, so that a result depends on its inputs alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
CATEGORIES = ("primary", "model", "product", "industry", "paper", "tutorial")


#: The columns that a model writes (translations, digests, reasons, topics), derived from a row's id and text so that every
#: branch of what reads them has rows. One text of SQL serves both engines: {id} and {text} stand for the document's columns.
DERIVED = {
    "title_zh": "case {id} % 4 when 0 then translate(concat('', ({id} * 7919) % 1000003 + 1000000), '0123456789', '模型新产品发布研究用') when 1 then '' end",
    "summary": "case {id} % 5 when 1 then concat('**要点**：第', {id}, '条消息说明了一件事，读者可以在这里了解它的经过和影响。') when 2 then '短讯。' when 3 then substr({text}, 1, 200) when 4 then '' end",
    "digest": "case {id} % 6 when 0 then concat('这一条是第', {id}, '篇文章的导读，它说清了事情的来龙去脉，也说了接下来会怎样，读者看完就知道要不要点开，也知道下一步可以去哪里找更多的材料，更不会白费时间。') when 1 then '导读很短。' when 2 then substr({text}, 1, 90) when 3 then '' end",
    "digest_zh": "case {id} % 7 when 0 then concat('中文导读：编号', {id}, '的文章讲了三件事。第一件在昨天发生！第二件还在继续。') when 1 then concat('中文 ', substr({text}, 1, 60)) when 2 then '' end",
    "reason": "case {id} % 8 when 0 then concat('值得读：它给出了编号', {id}, '的数据。') when 1 then '导读很短。' when 2 then '' when 3 then concat('中文导读：编号', {id}, '的文章讲了三件事。第一件在昨天发生！第二件还在继续。') when 4 then substr({text}, 1, 40) end",
    "brief_zh": "case {id} % 9 when 0 then concat('早报：第', {id}, '条，这是一段完整的中文话。') when 1 then substr({text}, 1, 80) when 2 then concat('前一句是中文而且足够长。', substr({text}, 1, 40)) end",
    "topics": "case {id} % 3 when 0 then concat('[\"主题', {id} % 5, '\", \"topic', {id} % 4, '\"]') when 1 then '[]' end",
    "content_zh": "case {id} % 5 when 0 then concat('中文正文。', repeat(concat('这是第', {id}, '篇文章里的一句话，它在说一件事情。'), cast(1 + {id} % 4 as int))) when 1 then ' ' end",
    "process_attempts": "cast({id} % 8 as int)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Titles are cut before the join, so that queries over titles alone take no texts through it.
    docs = table(spark, sf_dir, "documents").withColumn("title", F.expr(r"substr(split_part(text, '\n', 1), 1, 120)"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    category = F.lit(None).cast("string")
    for n, name in enumerate(CATEGORIES):
        category = F.when(F.expr(f"doc_id % 7 = {n}"), name).otherwise(category)
    published = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (doc_id * 7919) % 2592000)")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.expr("try_cast(substr(source, 4) as int)").alias("source_id"),
        "title",
        F.expr("concat('https://', source, '.example.com/', cast(doc_id as string))").alias("link"),
        F.expr(r"replace(text, '\n', '\n\n')").alias("content_full"),
        published.alias("published_at"),
        F.col("quality").alias("relevance"),
        F.expr("case when quality = 1 then cast((doc_id * 37) % 101 as int) end").alias("score"),
        category.alias("category"),
        F.expr("concat('t', cast(doc_id % 11 as string), ', u', cast(doc_id % 13 as string))").alias("tags"),
        F.expr("case doc_id % 10 when 0 then 'pending' when 1 then 'failed' when 2 then 'draft' else 'processed' end").alias("status"),
        F.expr("case when doc_id % 5 = 0 then 1 else 0 end").alias("starred"),
        F.expr("case when doc_id % 23 = 22 then doc_id - 1 end").alias("duplicate_of"),
        F.when(F.expr("doc_id % 17 = 16"), published).alias("deleted_at"),
        "lang",
        *[F.expr(sql.format(id="doc_id", text="text")).alias(name) for name, sql in DERIVED.items()],
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name), one row for each source of the documents."""
    return table(spark, sf_dir, "documents").select(F.expr("try_cast(substr(source, 4) as int)").alias("id"), F.col("source").alias("name")).distinct()


#: The same frames in DuckDB's SQL, as the beginning of every query's oracle.
ARTICLES_SQL = f"""WITH a AS (
  SELECT d.doc_id AS id, cast(substr(d.source, 4) AS int) AS source_id,
    substr(split_part(d.text, chr(10), 1), 1, 120) AS title,
    concat('https://', d.source, '.example.com/', cast(d.doc_id AS varchar)) AS link,
    replace(d.text, chr(10), chr(10) || chr(10)) AS content_full,
    timestamp '2024-01-01 00:00:00' + to_seconds((d.doc_id * 7919) % 2592000) AS published_at,
    l.quality AS relevance,
    CASE WHEN l.quality = 1 THEN cast((d.doc_id * 37) % 101 AS int) END AS score,
    CASE d.doc_id % 7 WHEN 0 THEN 'primary' WHEN 1 THEN 'model' WHEN 2 THEN 'product' WHEN 3 THEN 'industry' WHEN 4 THEN 'paper' WHEN 5 THEN 'tutorial' END AS category,
    concat('t', cast(d.doc_id % 11 AS varchar), ', u', cast(d.doc_id % 13 AS varchar)) AS tags,
    CASE d.doc_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'draft' ELSE 'processed' END AS status,
    CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS starred,
    CASE WHEN d.doc_id % 23 = 22 THEN d.doc_id - 1 END AS duplicate_of,
    CASE WHEN d.doc_id % 17 = 16 THEN timestamp '2024-01-01 00:00:00' + to_seconds((d.doc_id * 7919) % 2592000) END AS deleted_at,
    d.lang, {", ".join(sql.format(id="d.doc_id", text="d.text") + " AS " + name for name, sql in DERIVED.items())}
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT DISTINCT cast(substr(source, 4) AS int) AS id, source AS name FROM documents),
vis AS (SELECT * FROM a WHERE duplicate_of IS NULL AND deleted_at IS NULL),
rep AS (SELECT * FROM vis WHERE relevance = 1 AND status IN ('processed', 'failed', 'pending')),
win AS (SELECT * FROM rep WHERE published_at >= timestamp '2024-01-31 00:00:00' - INTERVAL 30 DAY)
"""
