"""The catalog of remote samples, as a table."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the catalog's labels may be.
KINDS = ("envi-http",)
AVAILABILITY = ("deterministic-local", "public")
TIERS = ("local", "public")
SAMPLE = "struct<id:string,title:string,kind:string,availability:string,validationTier:string,description:string,headerUrl:string,dataUrl:string,headers:map<string,string>,license:string>"
SCHEMA = f"version int, catalogId string, description string, samples array<{SAMPLE}>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return samples_of(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def samples_of(catalog: DataFrame) -> DataFrame:
    """One row a sample, with defaults. A sample that breaks a rule has its problem set."""
    s = catalog.select(F.explode("samples").alias("s")).select("s.*")
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    out = s.select(
        text(F.col("id")).alias("id"), text(F.col("title")).alias("title"), text(F.col("kind")).alias("kind"),
        F.coalesce("availability", F.lit("deterministic-local")).alias("availability"), F.coalesce("validationTier", F.lit("local")).alias("validation_tier"),
        text(F.col("description")).alias("description"), text(F.col("headerUrl")).alias("header_url"), text(F.col("dataUrl")).alias("data_url"), "headers", text(F.col("license")).alias("license"),
    )
    return out.withColumn("problem", problem())


def problem() -> Column:
    out = F.lit(None).cast("string")
    for name in ("data_url", "header_url", "title", "id"):
        out = F.when(F.col(name).isNull(), f"missing {name}").otherwise(out)
    for name, allowed in (("validation_tier", TIERS), ("availability", AVAILABILITY), ("kind", KINDS)):
        out = F.when(~F.coalesce(F.col(name).isin(*allowed), F.lit(False)), f"unsupported {name}").otherwise(out)
    return out


def duplicate_ids(samples: DataFrame) -> DataFrame:
    return samples.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked(samples: DataFrame) -> DataFrame:
    """samples, or an error when one breaks a rule or an id is there twice."""
    bad = samples.where("problem is not null").select(F.concat_ws(": ", "id", "problem").alias("why")).union(duplicate_ids(samples).select(F.concat(F.lit("duplicate id: "), "id"))).first()
    if bad:
        raise ValueError(bad.why)
    return samples.drop("problem")


def sample(samples: DataFrame, sample_id: str) -> DataFrame:
    return samples.where(F.col("id") == sample_id)


def by_tier(samples: DataFrame, tier: str) -> DataFrame:
    return samples if tier == "all" else samples.where(F.col("validation_tier") == tier)


def without_dots(path: Column) -> Column:
    """A path without "." and "..": "a/../b" is "b", and ".." at the top is nothing."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        # the empty part before a leading "/" stays where it is
        lambda done, p: F.when(p == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(p == ".", done).otherwise(F.concat(done, F.array(p))),
    )
    open_end = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), open_end)


def resolved(url: Column, base: str) -> Column:
    """The URL that a reference means beside the base: schemes, "//host", dot segments, "?query" and "#fragment" as in the URL standard, as one expression."""
    b = urlsplit(base)
    root = f"{b.scheme}://{b.netloc}"
    folder = (b.path or "/").rpartition("/")[0] + "/"
    tail = F.regexp_extract(url, r"([?#].*)?$", 1)
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    own = (f"{b.path}?{b.query}" if b.query else b.path) if b.path else ""
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.lit(f"{b.scheme}:"), url))
        .when(path.startswith("/"), F.concat(F.lit(root), without_dots(path), tail))
        .when(path != "", F.concat(F.lit(root), without_dots(F.concat(F.lit(folder), path)), tail))
        .when(tail.startswith("?"), F.concat(F.lit(root + b.path), tail))
        .otherwise(F.concat(F.lit(root + own), tail))
    )


def load_source(base: str | None = None) -> Column:
    """Of a sample what a load takes: a struct of kind, header, data (beside the base, if one is given) and request headers without nulls; null for a sample with a problem."""
    place = lambda c: F.col(c) if base is None else resolved(F.col(c), base)
    kept = F.map_filter("headers", lambda _, v: v.isNotNull())
    return F.when(F.col("problem").isNull(), F.struct("kind", place("header_url").alias("header"), place("data_url").alias("data"), F.when(F.size(kept) > 0, kept).alias("headers")))


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def browser_may_read(url: Column, origin: Column, allow: Column) -> Column:
    return (origin_of(url) == origin_of(origin)) | F.coalesce((allow == "*") | (allow == origin), F.lit(False))


def eligible(probes: DataFrame) -> DataFrame:
    """Evaluation of probe rows (header_url, data_url, origin, header_status, data_status, header_allow, data_allow, content_range)."""
    reached = (F.col("header_status") >= 200) & (F.col("header_status") < 300)
    ranged = (F.col("data_status") == 206) & F.col("content_range").isNotNull()
    may = browser_may_read(F.col("header_url"), F.col("origin"), F.col("header_allow")) & browser_may_read(F.col("data_url"), F.col("origin"), F.col("data_allow"))
    return probes.withColumns({"header_reachable": reached, "range_ok": ranged, "cors_ok": may, "eligible": reached & ranged & may})


def write_catalog(samples: DataFrame, path: str) -> None:
    """Samples as JSON lines, from the executors."""
    samples.write.mode("overwrite").json(path)
