"""Reading portfolio specs, and writing what is published."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SPEC


def scratch(spark: SparkSession) -> str:
    """A new folder where driver and executors both write, deleted when the application ends; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root or 'file://' + tempfile.mkdtemp(prefix='spark-')}/folionaut-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a written table: what several branches read is computed once, plans stay short, and a lost executor loses nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """df as a written table that remembers its partitioning: windows, groupings and joins on keys (all of them, or more columns besides) need no shuffle.

    One bucket for each shuffle partition, each one file. The table is external, in the folder of `scratch`, and known to the session's catalog only as long as that lasts;
    a catalog that outlives the application keeps its name, folionaut_ and a number. dealt: df's partitions are those of repartition(shuffles(spark), *keys) already.
    """
    spark = df.sparkSession
    path, n = scratch(spark), shuffles(spark)
    name = f"folionaut_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def read_specs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(portfolios, holdings) of the spec files under path: of each one object, laid out over any lines, an array of objects, or an object per line.

    What isn't a spec (broken JSON, an object without a portfolio, a value of the wrong type) fails the job that reads it, naming the file; nothing is lost in silence.
    A holding's quote currency is `quote_ccy` or `quote_ccy_google`.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    per_line = (F.size(lines) > 1) & F.forall(lines, lambda x: F.json_object_keys(x).isNotNull())
    whole = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    wrong = lambda: F.raise_error(F.concat(F.lit("not a portfolio spec: "), F.col("file")))
    texts = files.where(F.size(lines) > 0).select("file", F.explode(F.coalesce(F.when(per_line, lines).otherwise(whole), F.array(F.lit("")))).alias("text"))
    read = T.StructType([*SPEC.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = texts.withColumn("spec", F.from_json("text", read))
    bad = F.col("spec").isNull() | F.col("spec._corrupt_record").isNotNull() | F.col("spec.portfolio").isNull()
    specs = parsed.select(F.when(bad, wrong()).otherwise(F.col("spec")).alias("spec")).select("spec.*")
    portfolios = specs.select("portfolio", "label", "google_portfolio_id", "base_currency", "inception", "sync_date", "methodology")
    holdings = specs.select("portfolio", "inception", F.explode("holdings").alias("h")).select("portfolio", "inception", "h.*")
    return portfolios, holdings.withColumn("quote_ccy", F.coalesce("quote_ccy", "quote_ccy_google")).drop("quote_ccy_google")


def series_documents(navs: DataFrame, components: DataFrame) -> DataFrame:
    """portfolio and document, its JSON text: parallel arrays of dates and values, and a map from symbol to its values."""
    arrays = navs.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("date", "nav", "cash"))).alias("rows"))
    arrays = arrays.select("portfolio", F.col("rows.date").alias("date"), F.col("rows.nav").alias("nav"), F.col("rows.cash").alias("cash"))
    own = components.groupBy("portfolio", "symbol").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("rows"))
    maps = own.groupBy("portfolio").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("symbol"), F.col("rows.value").alias("values"))))).alias("components"))
    whole = arrays.join(maps, "portfolio")
    return whole.select("portfolio", F.to_json(F.struct(*(c for c in whole.columns if c != "portfolio"))).alias("document"))


def nested(df: DataFrame, name: str, *columns: str, key: str = "portfolio") -> DataFrame:
    """key and an array of structs, in the order of their first fields."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def payload_documents(heads: dict[str, DataFrame], children: dict[str, DataFrame]) -> DataFrame:
    """portfolio and document, its JSON text: for each of heads (one row per portfolio) an object, or its fields themselves where the name is empty; for each of children an array of objects.

    The blocks of all names are rows of one frame and meet in one grouping by portfolio, however many there are.
    """
    fields = lambda df: F.struct(*(c for c in df.columns if c != "portfolio"))
    blocks = [df.select("portfolio", F.lit(name).alias("name"), F.to_json(fields(df)).alias("json")) for name, df in heads.items()]
    for name, df in children.items():
        own = nested(df, "rows", *(c for c in df.columns if c != "portfolio"))
        blocks.append(own.select("portfolio", F.lit(name).alias("name"), F.to_json("rows").alias("json")))
    out = blocks[0]
    for more in blocks[1:]:
        out = out.unionByName(more)
    # An unnamed block's braces go.
    entry = F.when(F.col("name") == "", F.expr("substring(json, 2, length(json) - 2)")).otherwise(F.concat(F.lit('"'), F.col("name"), F.lit('":'), F.col("json")))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("name", entry.alias("entry")))), lambda x: x["entry"])
    return out.groupBy("portfolio").agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("document"))


def registry(navs: DataFrame, capital: DataFrame, summary: DataFrame, portfolios: DataFrame) -> DataFrame:
    """One summary row per portfolio: portfolio, label, base_ccy, inception, what else a spec says of it, asof, capital and the struct of its metrics."""
    ends = navs.groupBy("portfolio").agg(F.max("date").alias("asof"), F.max_by("nav", "date").alias("nav_last"))
    own = summary.withColumnRenamed("series_id", "portfolio").join(ends, "portfolio")
    metrics = F.struct("nav_last", *(c for c in summary.columns if c != "series_id")).alias("metrics")
    own = own.select("portfolio", "asof", metrics)
    said = [c for c in ("google_portfolio_id", "sync_date", "methodology") if c in portfolios.columns]
    named = portfolios.select("portfolio", "label", "base_ccy", "inception", *said)
    return named.join(own, "portfolio").join(capital.select("portfolio", "capital"), "portfolio").select("portfolio", "label", "base_ccy", "inception", *said, "asof", "capital", "metrics")


VERSIONS = 16  # versions that may hold files of the present one; then all are written again
_DONE = "_PUBLISHED"


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions under path, oldest first. A version without its mark was never published, or isn't yet."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    return sorted(n for n in names if files.exists(make(f"{path}/{n}/{_DONE}")))


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What readers see: manifest (portfolio, fingerprint, version), registry, series and payload (portfolio, document) of the newest finished version."""
    newest = versions(spark, path)[-1]
    manifest = spark.read.schema("portfolio string, fingerprint string, version string").parquet(f"{path}/{newest}/manifest")
    held = [r[0] for r in manifest.select("version").distinct().collect()]  # at most VERSIONS
    out = {"manifest": manifest, "registry": spark.read.json(f"{path}/{newest}/registry")}
    for name in ("series", "payload"):
        parts = [_texts(spark, f"{path}/{v}/{name}", v) for v in held]
        frame = parts[0]
        for more in parts[1:]:
            frame = frame.unionByName(more)
        out[name] = frame.join(manifest.select("portfolio", "version"), ["portfolio", "version"], "left_semi").select("portfolio", "document")
    return out


def _texts(spark: SparkSession, path: str, version: str) -> DataFrame:
    """portfolio, document, version of a version's files."""
    return spark.read.option("basePath", path).text(path).select(F.col("portfolio").cast("string").alias("portfolio"), F.col("value").alias("document"), F.lit(version).alias("version"))


def write_outputs(spark: SparkSession, path: str, registry: DataFrame, series: DataFrame, payload: DataFrame, disclaimer: str, portfolios: DataFrame | None = None) -> str:
    """Publishes a version under path, a folder: a JSON file per portfolio of series and payload (portfolio, document), the registry with the time of writing, and a manifest. Returns its name.

    A version becomes visible by its mark, an empty file that is made last; readers see the one before until then, and a run that fails leaves nothing that they see. Portfolios whose fingerprint (of both
    documents) is that of the version before aren't written again: the manifest names the version that holds their files. portfolios: those to write from scratch, whatever their fingerprint.
    """
    before = versions(spark, path)
    own = f"{int(before[-1].split('-')[0]) + 1 if before else 1:08d}-{uuid.uuid4().hex[:8]}"
    both = stored(series.select("portfolio", F.col("document").alias("series")).join(payload.select("portfolio", F.col("document").alias("payload")), "portfolio", "full").withColumn("fingerprint", F.sha2(F.concat_ws("\n", F.coalesce("series", F.lit("")), F.coalesce("payload", F.lit(""))), 256)))
    manifest = both.select("portfolio", "fingerprint", F.lit(own).alias("version"))
    if before:
        last = spark.read.schema("portfolio string, fingerprint string, version string").parquet(f"{path}/{before[-1]}/manifest")
        if last.select("version").distinct().count() < VERSIONS:
            same = last.select("portfolio", "fingerprint", F.col("version").alias("held"))
            same = same if portfolios is None else same.join(portfolios.select("portfolio"), "portfolio", "left_anti")
            manifest = manifest.join(same, ["portfolio", "fingerprint"], "left").select("portfolio", "fingerprint", F.coalesce("held", "version").alias("version"))
    manifest.write.parquet(f"{path}/{own}/manifest")
    fresh = spark.read.schema(manifest.schema).parquet(f"{path}/{own}/manifest").where(F.col("version") == own).select("portfolio")
    for name in ("series", "payload"):
        rows = both.join(fresh, "portfolio").where(F.col(name).isNotNull()).select("portfolio", F.col(name).alias("value"))
        rows.repartition("portfolio").write.partitionBy("portfolio").text(f"{path}/{own}/{name}")
    registry.withColumns({"generated": F.current_timestamp(), "disclaimer": F.lit(disclaimer)}).write.json(f"{path}/{own}/registry")
    files, mark = _files(spark, f"{path}/{own}/{_DONE}")
    files.create(mark, False).close()
    return own
