"""Raw site features -> numeric, complete model matrix; what reaches the driver is a few rows of aggregates."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from lodestead import config as C
from lodestead import sinks
from lodestead.session import stage

EMPTY = "array<string>"
NUMBER = r"(?i)^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?\s*$|^\s*[+-]?inf(?:inity)?\s*$"
#: Relative error of the sketch that brackets a median before it is counted exactly.
ACCURACY = 10_000


def listlike(df: DataFrame, name: str) -> Column:
    """A list column as an array: a text like ['a', 'b'] is parsed, anything else is empty; absent columns too."""
    if name not in df.columns:
        return F.array().cast(EMPTY)
    if isinstance(df.schema[name].dataType, ArrayType):
        return F.coalesce(F.col(name), F.array().cast(EMPTY))
    return parse_list(F.col(name))


def parse_list(text: Column) -> Column:
    s = F.trim(text)
    parsed = F.from_json(F.when(s.startswith("[") & s.endswith("]"), s), EMPTY, {"allowSingleQuotes": "true"})
    return F.coalesce(parsed, F.array().cast(EMPTY))


def number(c: Column) -> Column:
    """DOUBLE, null where it is no number; a text like 1d is none."""
    d = c.try_cast("double")
    plain = (F.typeof(c) != "string") | c.cast("string").rlike(NUMBER)
    return F.when(plain & ~F.isnan(d), d)


def to_bool(c: Column) -> Column:
    """1.0 / 0.0 for true, True, 1 and their opposites, else null."""
    s = c.cast("string")
    return F.when(s.isin("true", "True", "1", "1.0"), 1.0).when(s.isin("false", "False", "0", "0.0"), 0.0)


def over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def tld_flags(tld: Column) -> dict[str, Column]:
    t = F.lower(F.coalesce(tld, F.lit("")))
    edu, gov = t == "edu", t.endswith("gov") | t.endswith("us")
    org, com = t == "org", t.isin("com", "net")
    return {"is_edu_tld": edu.cast("int"), "is_gov_or_state_tld": gov.cast("int"), "is_org_tld": org.cast("int"), "is_com_net_tld": com.cast("int"), "is_foreign_or_other_tld": (~(edu | gov | org | com) & (t != "")).cast("int")}


def features(df: DataFrame, max_pages: float | None, year_now: int, min_pages_for_ratios: int = 3) -> DataFrame:
    """IDs and all features before imputation; ``max_pages`` is the largest page count seen."""

    def has(c: str) -> bool:
        return c in df.columns

    def num(c: str) -> Column:
        return number(F.col(c)) if has(c) else F.lit(None).cast("double")

    ids = [f"`{c}`" for c in C.ID_COLUMNS if has(c)]
    out: dict[str, Column] = {}
    pages = num("pages_crawled")
    out["crawl_failed"] = F.col("crawl_error").isNotNull().cast("int") if has("crawl_error") else F.lit(0)
    out["pages_hit_cap"] = F.coalesce((pages >= float(max_pages or 0)) & F.lit((max_pages or 0) > 1), F.lit(False)).cast("int")
    out |= tld_flags(F.col("tld") if has("tld") else F.lit(None).cast("string"))
    if has("domain_age_days"):
        out["domain_age_years"] = num("domain_age_days") / 365.25
    if has("max_copyright_year"):
        y = num("max_copyright_year")
        out["copyright_staleness_years"] = F.when(y.isNotNull(), F.greatest(F.lit(0.0), F.lit(float(year_now)) - y))
        if has("min_copyright_year"):
            out["copyright_year_span"] = y - num("min_copyright_year")
    lists = {c: listlike(df, c) for c in C.LIST_COLUMNS}
    for name, c in (("n_css_frameworks", "css_frameworks"), ("n_site_builders", "site_builders_detected"), ("n_meta_generators", "meta_generators"), ("n_css_files_hashed", "css_content_hashes")):
        out[name] = F.size(lists[c])
    out["n_tracker_ids"] = sum((F.size(lists[c]) for c in ("ga4_ids", "gtm_ids", "fb_pixel_ids")), F.size(lists["ga_ua_ids"]))
    out["has_any_analytics"] = (out["n_tracker_ids"] > 0).cast("int")
    out["has_fb_pixel"] = (F.size(lists["fb_pixel_ids"]) > 0).cast("int")
    for c, name in C.RATE_COLUMNS:
        if has(c):
            out[name] = over(num(c), pages)
    if has("total_external_links") and has("total_internal_links"):
        out["external_link_share"] = over(num("total_external_links"), num("total_external_links") + num("total_internal_links"))
    if has("trusted_outbound_links") and has("total_external_links"):
        out["trusted_share_of_external"] = over(num("trusted_outbound_links"), num("total_external_links"))
    if has("sitemap_url_count"):
        r = over(pages, num("sitemap_url_count"))
        out["crawl_coverage_ratio"] = F.when(r.isNotNull(), F.least(F.lit(1.0), r))
    for c in C.LOG_COLUMNS:
        if has(c):
            out[f"log1p_{c}"] = F.log1p(num(c))
    tiny = pages < min_pages_for_ratios
    for c in C.PASSTHROUGH_COLUMNS:
        if has(c):
            masked = c in ("boilerplate_ratio", "dom_structure_diversity")
            out[c] = F.when(F.coalesce(tiny, F.lit(False)), F.lit(None)).otherwise(num(c)) if masked else num(c)
    for c in C.BOOL_COLUMNS:
        if has(c):
            out[c] = F.col(c).cast("double") if isinstance(df.schema[c].dataType, BooleanType) else to_bool(F.col(c))
    return df.select(*ids, *[e.alias(n) for n, e in out.items()])


def profile(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per column count, min, max and exact median, and the number of rows.

    A sketch of bounded size tells between which two values a median lies; only values between them are counted one by
    one, so no task holds a column's distinct values.  ``df`` is read three times and should be staged.
    """
    parts, near = [F.count("*").alias("rows")], F.array(F.lit(0.5 - 2 / ACCURACY), F.lit(0.5 + 2 / ACCURACY))
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        parts += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.percentile_approx(v, near, ACCURACY).alias(f"at{i}")]
    row = df.agg(*parts).first()
    out = {"": {"rows": row["rows"]}} | {c: {"n": row[f"n{i}"], "lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "median": row[f"lo{i}"]} for i, c in enumerate(columns)}
    wide = [i for i in range(len(columns)) if row[f"n{i}"] and row[f"lo{i}"] < row[f"hi{i}"]]
    if not wide:
        return out
    value = {i: F.col(f"`{columns[i]}`").cast("double") for i in wide}
    below = df.agg(*[F.count_if(value[i] < row[f"at{i}"][0]).alias(f"b{i}") for i in wide]).first()
    # ranks of the two middle values among those that are not below the bracket
    first = {i: (row[f"n{i}"] - 1) // 2 - below[f"b{i}"] for i in wide}
    last = {i: row[f"n{i}"] // 2 - below[f"b{i}"] for i in wide}
    inside = F.filter(F.array(*[F.when(value[i].between(*row[f"at{i}"]), F.struct(F.lit(i).alias("i"), value[i].alias("v"))) for i in wide]), lambda x: x.isNotNull())
    counts = df.select(F.explode(inside).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("k")).toDF("i", "v", "k")
    rank = F.sum("k").over(Window.partitionBy("i").orderBy("v"))
    wanted = df.sparkSession.createDataFrame([(i, r) for i in wide for r in (first[i], last[i])], "i int, r bigint")
    found = counts.withColumn("to", rank).join(F.broadcast(wanted), "i").where((F.col("r") < F.col("to")) & (F.col("r") >= F.col("to") - F.col("k")))  # two rows a column
    middle: dict[int, list[float]] = {}
    for r in found.select("i", "v").collect():
        middle.setdefault(r["i"], []).append(r["v"])
    for i in wide:
        out[columns[i]]["median"] = sum(middle[i]) / 2 if len(middle.get(i, ())) == 2 else df.agg(F.median(value[i])).first()[0]  # the sketch keeps its error, so the first
    return out


def complete(df: DataFrame, columns: list[str], stats: dict[str, dict], drop_constant: bool = True, keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """Missing indicators, median imputation, constant columns dropped: one projection, decided by ``profile``.

    Columns named in ``keep`` stay even if constant, for callers whose schema must not hang on the data."""
    rows = stats[""]["rows"]
    ids = [f"`{c}`" for c in df.columns if c not in columns]
    medians, dropped, kept, flags, lost = {}, [], [], [], []
    for c in columns:
        s = stats[c]
        fill = s["median"] if s["n"] else 0.0
        missing = s["n"] < rows
        if missing:
            medians[c] = fill
        constant = s["n"] == 0 or s["lo"] == s["hi"]
        value = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(fill))) if missing else F.col(f"`{c}`")
        if drop_constant and constant and c not in keep:
            dropped.append(c)
        else:
            kept.append(value.alias(c))
        if missing:
            if drop_constant and s["n"] == 0 and c not in keep:
                lost.append(f"{c}_missing")
            else:
                flags.append(F.col(f"`{c}`").isNull().cast("int").alias(f"{c}_missing"))
    report = {"imputation_medians": medians, "dropped_constant_columns": dropped + lost, "n_features_out": len(kept) + len(flags)}
    return df.select(*ids, *kept, *flags), report


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw features from a CSV file, or from a folder of CSV or Parquet files."""
    file = spark.read.format("binaryFile").load(path).select("path").first()  # names only
    text = path.endswith(".csv") or file is not None and ".csv" in file[0].rpartition("/")[2]
    return spark.read.option("header", True).csv(path) if text else spark.read.parquet(path)


def build_model_matrix(
    source: DataFrame | str, year_now: int | None = None, min_pages_for_ratios: int = 3, drop_constant_columns: bool = True, output_csv: str | None = None, spark: SparkSession | None = None
) -> tuple[DataFrame, dict]:
    """(matrix, report) of a table of raw features or of one at a path.  ``year_now`` is a parameter, so that a run can be
    repeated; this year by default.  With ``output_csv`` the matrix is written there too."""
    if isinstance(source, str):
        source = read_raw(spark or SparkSession.builder.getOrCreate(), source)
    if "pages_crawled" not in source.columns:
        raise KeyError("pages_crawled")
    year_now = year_now or datetime.date.today().year
    pages = number(F.col("pages_crawled"))
    failed = F.col("crawl_error").isNotNull() if "crawl_error" in source.columns else F.lit(False)
    rows, n_failed, n_tiny, most = source.agg(F.count("*"), F.count_if(failed), F.count_if(pages < min_pages_for_ratios), F.max(pages)).first()
    pre, _ = stage(features(source, most, year_now, min_pages_for_ratios), "features")
    columns = [c for c in pre.columns if c not in C.ID_COLUMNS]
    out, report = complete(pre, columns, profile(pre, columns), drop_constant_columns)
    report = {"n_rows_in": rows, "n_failed_crawls": n_failed, "n_tiny_crawls": n_tiny} | report
    if output_csv:
        sinks.write_csv(out, output_csv)
        report["output"] = output_csv
    return out, report


def report_table(spark, report: dict) -> DataFrame:
    """The report as a table of one row."""
    row = (report["n_rows_in"], report["n_failed_crawls"], report["n_tiny_crawls"], report["n_features_out"], report["imputation_medians"], report["dropped_constant_columns"])
    return spark.createDataFrame([row], "n_rows_in bigint, n_failed_crawls bigint, n_tiny_crawls bigint, n_features_out bigint, imputation_medians map<string,double>, dropped_constant_columns array<string>")


def summarize(report: dict) -> str:
    """The report in words."""
    lines = [f"rows in: {report['n_rows_in']}", f"failed crawls kept: {report['n_failed_crawls']}"]
    if "n_tiny_crawls" in report:
        lines.append(f"tiny crawls: {report['n_tiny_crawls']} (two ratios set to missing)")
    lines += [f"features out: {report['n_features_out']}", f"imputed columns: {len(report['imputation_medians'])}"]
    if report["dropped_constant_columns"]:
        lines.append(f"dropped as constant: {', '.join(report['dropped_constant_columns'])}")
    if "output" in report:
        lines.append(f"saved: {report['output']}")
    return "\n".join(lines)
