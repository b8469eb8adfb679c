"""Bronze, silver and catalog layers as Parquet folders, security-code aliases, and quality checks.

Bronze is appended to; silver holds the latest row of each key.  A table is a numbered manifest that names its parts: a base
and what has been taken in since.  Taking in a batch writes the batch alone and the next manifest, so its cost does not grow
with the table; readers keep the newest row of each key over all parts, and after ``PARTS`` of them the table is written as
one part again.  A manifest appears by a rename to a number that was free: readers see the old or the new version, whole, and
two writers cannot both take one number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantlake.specs import CODE_ALIASES, CROSS_CHECKS, DATASETS, NULLABLE_KEYS, DatasetSpec

META = ("_batch_id", "_ingested_at")
#: Parts of a table beyond which it is written anew, and manifests that are kept for readers of older versions.
PARTS, VERSIONS = 8, 3


def code_columns(dataset: str, columns: Iterable[str]) -> list[str]:
    name = "con_code" if dataset == "index_weight" else "ts_code"
    return [name] if name in columns and not (dataset.startswith("index_") and dataset not in ("index_weight", "index_member_all")) else []


def canonical_codes(df: DataFrame, dataset: str, rank: str | None = None) -> DataFrame:
    """Former codes replaced by current ones; ``rank`` names a column that is 1 where a row had a former one."""
    columns = code_columns(dataset, df.columns)
    if rank:
        was = F.lit(False)
        for c in columns:
            was = was | F.coalesce(F.col(c).isin(list(CODE_ALIASES)), F.lit(False))
        df = df.withColumn(rank, was.cast("int"))
    return df.replace(CODE_ALIASES, subset=columns) if columns else df


def latest_per_key(df: DataFrame, key: Iterable[str], order: Iterable = ()) -> DataFrame:
    """The first row of each key in the given order (newest ingestion, then batch, by default)."""
    order = list(order) or [F.col(c).desc_nulls_last() for c in ("_ingested_at", "_batch_id") if c in df.columns]
    rows = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return rows.filter("_rn = 1").drop("_rn")


def merged(spec: DatasetSpec, parts: Iterable[DataFrame]) -> DataFrame:
    """Parts united by name, codes made canonical, and one row kept for each key: the newest, a current code before a former one."""
    every = None
    for part in parts:
        part = canonical_codes(part, spec.name, "_alias")
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    missing = set(spec.primary_key) - set(every.columns)
    if missing:
        raise ValueError(f"{spec.name}: key columns are missing: {sorted(missing)}")
    order = [F.col(c).desc_nulls_last() for c in ("_ingested_at", "_batch_id") if c in every.columns]
    return latest_per_key(every, spec.primary_key, [*order, F.col("_alias")]).drop("_alias", "_api_name", "_params_json")


def with_row_numbers(df: DataFrame, spec: DatasetSpec, arrival: str) -> DataFrame:
    """``_row_no`` from 1 in the order of arrival within a date, where the key asks for it."""
    if "_row_no" not in spec.primary_key or "_row_no" in df.columns:
        return df
    keys = [c for c in spec.primary_key if c != "_row_no" and c in df.columns]
    return df.withColumn("_row_no", F.row_number().over(Window.partitionBy(*keys).orderBy(arrival)))


class Lake:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, name: str):  # noqa: ANN202
        return self._path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self, name: str) -> list[str]:
        """File names of a table's manifests, the newest last."""
        fs, path = self._fs(name), self._path(name)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(x for x in names if x.startswith("manifest-"))

    def _parts(self, name: str) -> tuple[int, list[str]]:
        """A table's version, 0 if there is none, and its parts."""
        found = self._manifests(name)
        if not found:
            return 0, []
        text = self.spark.read.text(f"{self.root}/{name}/{found[-1]}", wholetext=True).first()[0]
        return int(found[-1].removeprefix("manifest-").removesuffix(".json")), json.loads(text)["parts"]

    def _commit(self, name: str, version: int, parts: list[str]) -> None:
        """Publish a version that follows ``version``; fails if another writer has."""
        fs = self._fs(name)
        new, final = self._path(f"{name}/new-{uuid.uuid4().hex}"), self._path(f"{name}/manifest-{version + 1:012d}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(new, final):
            fs.delete(new, False)
            raise RuntimeError(f"{name}: another writer has published version {version + 1}")
        for old in self._manifests(name)[:-VERSIONS]:
            fs.delete(self._path(f"{name}/{old}"), False)
        kept = {x for m in self._manifests(name) for x in json.loads(self.spark.read.text(f"{self.root}/{name}/{m}", wholetext=True).first()[0])["parts"]}
        for folder in fs.listStatus(self._path(name)):
            part = folder.getPath().getName()
            if part.startswith("part-") and part not in kept:
                fs.delete(folder.getPath(), True)

    def _write(self, name: str, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{part}")
        return part

    def _swap(self, name: str, df: DataFrame) -> None:
        version, _ = self._parts(name)
        self._commit(name, version, [self._write(name, df)])

    def _read(self, name: str, parts: list[str]) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.root}/{name}/{p}") for p in parts]

    def table(self, name: str) -> DataFrame | None:
        """A table that is always written whole."""
        _, parts = self._parts(name)
        return self._read(name, parts)[0] if parts else None

    def silver(self, dataset: str) -> DataFrame | None:
        _, parts = self._parts(f"silver/{dataset}")
        tables = self._read(f"silver/{dataset}", parts)
        return None if not tables else tables[0] if len(tables) == 1 else merged(DATASETS[dataset], tables)

    def bronze(self, dataset: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/bronze/{dataset}/*")
        except AnalysisException:
            return None

    def write_bronze(self, spec: DatasetSpec, df: DataFrame, batch: str, params: Mapping, at: str) -> str:
        path = f"{self.root}/bronze/{spec.name}/{batch}"
        extra = {"_batch_id": F.lit(batch), "_api_name": F.lit(spec.source), "_params_json": F.lit(json.dumps(dict(params), sort_keys=True)), "_ingested_at": F.lit(at)}
        df.withColumns(extra).write.mode("append").parquet(path)
        return path

    def take_in(self, spec: DatasetSpec, rows: DataFrame) -> None:
        """Upsert rows that carry their own stamps: of each key the newest stays, wherever it came from."""
        name = f"silver/{spec.name}"
        version, parts = self._parts(name)
        part = self._write(name, merged(spec, [rows]))
        old = self._read(name, parts)
        # A silver table without the key is of no use to an upsert: what arrives replaces it.
        parts = [*parts, part] if old and not set(spec.primary_key) - set(old[0].columns) else [part]
        if len(parts) > PARTS:
            parts = [self._write(name, merged(spec, self._read(name, parts)))]
        self._commit(name, version, parts)

    def upsert_silver(self, spec: DatasetSpec, df: DataFrame, batch: str, at: str) -> None:
        """Upsert a batch, all of whose rows arrived at one time."""
        self.take_in(spec, df.withColumns({"_batch_id": F.lit(batch), "_ingested_at": F.lit(at)}))

    def consolidate_bronze(self, spec: DatasetSpec) -> int | None:
        """Silver anew, as one part, from all of bronze and what silver has; the number of rows."""
        rows = self.bronze(spec.name)
        if rows is None:
            return None
        old = self.silver(spec.name)
        self._swap(f"silver/{spec.name}", merged(spec, [rows] if old is None else [old, rows]))
        return self.silver(spec.name).count()

    def repair_aliases(self, specs: Iterable[DatasetSpec]) -> dict[str, tuple[int, int, int]]:
        """(rows before, rows after, rows with former codes); tables without such rows are left alone."""
        out = {}
        for spec in specs:
            rows = self.silver(spec.name)
            columns = code_columns(spec.name, rows.columns) if rows is not None else []
            if not columns:
                continue
            before, former = rows.agg(F.count("*"), F.count_if(F.col(columns[0]).isin(list(CODE_ALIASES)))).first()
            if former:
                self._swap(f"silver/{spec.name}", merged(spec, [rows]))
            out[spec.name] = (before, self.silver(spec.name).count() if former else before, former)
        return out


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Rows of both; where both have a key, the new row, but with the old value in the columns ``keep`` where the new one is NULL."""
    a, b = old.alias("a"), new.alias("b")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    is_new = F.col("b._is_new").isNotNull()

    def pick(c: str) -> Column:
        mine = F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c not in old.columns:
            return mine
        return F.coalesce(mine, F.col(f"a.{c}")) if c in keep or c not in new.columns else F.when(is_new, mine).otherwise(F.col(f"a.{c}"))

    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    return a.join(new.withColumn("_is_new", F.lit(True)).alias("b"), on, "full_outer").select(*(pick(c).alias(c) for c in columns))


def validate(spec: DatasetSpec, df: DataFrame | None) -> tuple[str, str]:
    """(status, detail); the first check that fails decides.  All checks share one scan."""
    if df is None:
        return "missing", "no table"
    lost = [c for c in spec.primary_key if c not in df.columns]
    if lost:
        return "failed", f"missing key columns: {', '.join(lost)}"
    empty = F.lit(False)
    for c in spec.primary_key:
        if c not in NULLABLE_KEYS.get(spec.name, ()):
            empty = empty | F.col(c).isNull() | (F.col(c).cast("string") == "")
    date = spec.date_field if spec.date_field in df.columns else None
    bad = F.lit(False) if date is None else F.col(date).isNull() | ~F.col(date).cast("string").rlike("^[0-9]{8}$")
    per_key = df.groupBy(*spec.primary_key).agg(F.count("*").alias("n"), F.count_if(empty).alias("nulls"), F.count_if(bad).alias("dates"))
    n, nulls, repeated, dates = per_key.agg(F.sum("n"), F.sum("nulls"), F.count_if(F.col("n") > 1), F.sum("dates")).first()
    for failed, detail in ((not n, "empty table"), (nulls, f"null or empty keys: {nulls}"), (repeated, f"duplicate keys: {repeated}"), (dates, f"invalid dates: {dates}")):
        if failed:
            return "failed", detail
    return "passed", f"rows: {n}"


def duplicate_keys(df: DataFrame, key: Iterable[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def usability(daily: DataFrame, adj_factor: DataFrame, stock_basic: DataFrame, trade_cal: DataFrame, adjusted: DataFrame) -> DataFrame:
    """One row for each check between tables with the number of rows against it; ``daily`` is scanned once for all checks of its rows."""
    has = lambda df, key, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    rows = daily.select("ts_code", "trade_date").join(has(adj_factor, ["ts_code", "trade_date"], "a"), ["ts_code", "trade_date"], "left").join(has(stock_basic, ["ts_code"], "b"), "ts_code", "left")
    per_day = rows.groupBy("trade_date").agg(
        F.count("*").alias("n"), F.count_if(F.col("a").isNull()).alias("no_factor"), F.count_if(F.col("b").isNull()).alias("no_basic"), F.count_if(F.col("ts_code").isin(list(CODE_ALIASES))).alias("former")
    )
    total = per_day.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "no_factor", "no_basic", "former")), F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    open_days = trade_cal.filter(F.col("is_open").cast("string") == "1").select("cal_date").distinct()
    # One row a day on either side.
    days = open_days.join(per_day.select(F.col("trade_date").alias("cal_date"), F.lit(True).alias("has")), "cal_date", "left").filter("has is null")
    uncovered = days.crossJoin(total.select("lo", "hi")).filter(F.col("cal_date").between(F.col("lo"), F.col("hi"))).agg(F.count("*").alias("uncovered"))
    every = total.crossJoin(uncovered).crossJoin(adjusted.agg(F.count("*").alias("m")))
    checks = dict(zip(CROSS_CHECKS, ("no_factor", "no_basic", "former", "uncovered", "abs(n - m)"), strict=True))
    out = every.select(F.inline(F.array(*(F.struct(F.lit(name).alias("check_name"), F.expr(value).cast("long").alias("failures")) for name, value in checks.items()))))
    return out.withColumn("status", F.when(F.col("failures") == 0, "passed").otherwise("failed"))
