"""Markup and tokens made from the relational tables, so that the SQL side knows the answers from the rule that made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def color(key: str | Column, factor: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex((key * factor) % 16777216), 6, "0")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, content): a view for each part, its elements chosen by remainders of the key.

    A part's few bytes make a view that takes far longer to parse than to read, so the keys of a few splits are dealt out first, by
    path, which joins on it then find done. The number is given, since tasks that are counted by bytes would be joined to one again.
    """
    k = F.col("p_partkey")
    lines = [
        F.lit("<main>"),
        F.when(k % 3 == 0, F.concat(F.lit('<div style="top: '), k.cast("string"), F.lit('px">x</div>'))).otherwise(F.lit("<div>x</div>")),
        F.when(k % 4 == 0, F.concat(F.lit('<rect fill="'), color(k, 7919), F.lit('" data-id="#123"></rect>'))).otherwise(F.lit("<p>text</p>")),
        F.when(k % 5 == 0, F.concat(F.lit('<p class="a p-['), k.cast("string"), F.lit('px]">y</p>'))).otherwise(F.lit('<p class="a">y</p>')),
        F.when(k % 6 == 0, F.lit('<img src="i.png">')).otherwise(F.lit('<img src="i.png" alt="">')),
        F.when(k % 7 == 0, F.lit("<button><i></i></button>")).when(k % 7 == 1, F.lit("<button><%= label %></button>")).otherwise(F.lit("<button>Go</button>")),
        F.when(k % 8 == 0, F.lit('<a href="/x"></a>')).when(k % 8 == 1, F.lit('<a href="/x" title="t"></a>')).otherwise(F.lit("<a>plain</a>")),
        F.when(k % 9 == 0, F.lit('<input id="f">')).when(k % 9 == 1, F.lit('<label for="g">L</label><input id="g">')).otherwise(F.lit('<input type="hidden">')),
        F.when(k % 10 < 3, F.concat(F.lit('<b class="z y x w '), F.concat(F.lit("v"), (k % 2).cast("string")), F.lit('">t</b>'))).otherwise(F.lit("<b>t</b>")),
        F.when(k % 11 == 0, F.lit("<svg>\n<path/></svg>")).when(k % 11 == 1, F.lit('<svg><use href="#icon-a"/></svg>')).otherwise(F.lit("<!-- none -->")),
        F.when(k % 12 == 0, F.lit("ok ✓ then 📄")).when(k % 12 == 1, F.lit("<%# ✓ %>")).otherwise(F.lit("plain ©")),
        F.lit("</main>"),
    ]
    path = F.concat(F.lit("app/views/p"), (k % 20).cast("string"), F.lit("/"), k.cast("string"), F.lit(".html.erb"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "part").select(path.alias("path"), "p_partkey").repartition(tasks, "path").select("path", F.concat_ws("\n", *lines).alias("content"))


PART_PATH = "'app/views/p' || (p_partkey % 20) || '/' || p_partkey || '.html.erb'"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens(name, value, syntax, ordinal) of the suppliers; colours repeat, near ones are a few steps from parts' colours."""
    k = F.col("s_suppkey")
    value = color(F.when(k % 2 == 0, k * 4 * 7919).otherwise((k * 4 * 7919 + 2)), 1)
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), k.cast("string")).alias("name"), value.alias("value"), F.when(k % 3 == 0, "tailwind").otherwise("css_var").alias("syntax"), k.alias("ordinal"))


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", color(k, 7919).alias("value"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
