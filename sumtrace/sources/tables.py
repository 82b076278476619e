"""The eight base tables, from Parquet or from ``|``-separated text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sumtrace.functions.exact import scaled
from sumtrace.sources import completion
from sumtrace.sources.schemas import SCHEMAS

TABLES = list(SCHEMAS)

# Two-decimal columns; they are held as whole hundredths.
MONEY = {
    "part": ["p_retailprice"],
    "supplier": ["s_acctbal"],
    "partsupp": ["ps_supplycost"],
    "customer": ["c_acctbal"],
    "orders": ["o_totalprice"],
    "lineitem": ["l_extendedprice", "l_discount", "l_tax"],
}
WHOLE = {"lineitem": ["l_quantity"], "partsupp": ["ps_availqty"]}


def read_text(spark: SparkSession, folder: str, name: str, files: str = "{,.[0-9]*}") -> DataFrame:
    """Read ``name.tbl`` and its numbered chunks; refresh files do not match, unless ``files`` asks for them.

    Each line ends with a separator, hence the extra column. A malformed line
    fails the read.
    """
    return (
        spark.read.schema(f"{SCHEMAS[name]}, _end STRING")
        .options(
            sep="|",
            mode="FAILFAST",
            dateFormat="yyyy-MM-dd",
            ignoreLeadingWhiteSpace=True,
            ignoreTrailingWhiteSpace=True,
        )
        .csv(f"{folder}/{name}.tbl{files}")
        .drop("_end")
    )


def write_text(df: DataFrame, name: str, folder: str, suffix: str = "") -> None:
    """Write ``name.tbl`` (and ``suffix``) as :func:`read_text` takes it; columns that ``df`` lacks stay empty."""
    fields = [f.strip().split(" ") for f in SCHEMAS[name].split(",")]
    have = [
        F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
        for c, kind in fields
    ]
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in have]
    line = F.concat(F.concat_ws("|", *cells), F.lit("|"))
    df.select(line.alias("value")).write.mode("overwrite").text(f"{folder}/{name}.tbl{suffix}")


def modified(spark: SparkSession, path: str) -> int | None:
    """When a path was last written, on whatever file system it names; None if it is not there."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    return files.getFileStatus(path).getModificationTime() if files.exists(path) else None


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on whatever file system the pattern names."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


_schemas: dict[tuple, StructType] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read a table; its footers are looked at once per session and version of the files."""
    key = (spark.sparkContext.applicationId, path, modified(spark, path))
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def in_hundredths(df: DataFrame, name: str, money_scale: int = 1) -> DataFrame:
    """Money and rates as whole hundredths, quantities as whole numbers.

    ``money_scale`` is 100 for input that was already multiplied by 100.
    """
    cols = {c: scaled(c, 100 // money_scale) for c in MONEY.get(name, [])}
    cols |= {c: scaled(c, 1) for c in WHOLE.get(name, [])}
    return df.withColumns(cols) if cols else df


class Tables:
    """Lazy table accessors over one folder.

    With ``money_scale`` 1 results come out in currency units; with 100 they stay
    in the whole units of the multiplied input.
    """

    def __init__(self, spark: SparkSession, folder: str, fmt: str = "parquet", money_scale: int = 1):
        if money_scale not in (1, 100):
            raise ValueError("money_scale is 1 or 100")
        self.spark = spark
        self.folder = str(folder).rstrip("/")
        self.fmt = fmt
        self.money_scale = money_scale

    def unit(self, digits: int) -> float:
        """What to divide a whole-unit result with ``digits`` implied decimals by."""
        return float(10**digits) if self.money_scale == 1 else 1.0

    def raw(self, name: str) -> DataFrame:
        if self.fmt == "text":
            return read_text(self.spark, self.folder, name)
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet")

    def _whole(self, name: str, df: DataFrame) -> DataFrame:
        return in_hundredths(df, name, self.money_scale)

    def rows(self, name: str, **ranges: tuple[int | None, int | None]) -> DataFrame:
        """A table with only the rows whose whole-unit columns lie in closed ranges.

        Conditions on scaled columns do not reach a Parquet scan. The same bounds, half a unit
        wider, are set on the stored columns first, which do.
        """
        raw = self.raw(name)
        for column, (low, high) in ranges.items():
            factor = 1 if column in WHOLE.get(name, []) else 100 // self.money_scale
            if low is not None:
                raw = raw.where(F.col(column) >= (low - 0.5) / factor - 1e-6)
            if high is not None:
                raw = raw.where(F.col(column) <= (high + 0.5) / factor + 1e-6)
        complete = getattr(completion, name, None)
        df = self._whole(name, complete(raw) if complete else raw)
        for column, (low, high) in ranges.items():
            if low is not None:
                df = df.where(F.col(column) >= low)
            if high is not None:
                df = df.where(F.col(column) <= high)
        return df

    @cached_property
    def region(self) -> DataFrame:
        return self.raw("region")

    @cached_property
    def nation(self) -> DataFrame:
        return self.raw("nation")

    @cached_property
    def customer(self) -> DataFrame:
        return self._whole("customer", completion.customer(self.raw("customer")))

    @cached_property
    def supplier(self) -> DataFrame:
        return self._whole("supplier", completion.supplier(self.raw("supplier")))

    @cached_property
    def part(self) -> DataFrame:
        return self._whole("part", completion.part(self.raw("part")))

    @cached_property
    def orders(self) -> DataFrame:
        return self._whole("orders", completion.orders(self.raw("orders")))

    @cached_property
    def lineitem(self) -> DataFrame:
        return self._whole("lineitem", completion.lineitem(self.raw("lineitem")))

    @cached_property
    def partsupp(self) -> DataFrame:
        stored = modified(self.spark, f"{self.folder}/partsupp.parquet") is not None
        if self.fmt == "text" or stored:
            return self._whole("partsupp", self.raw("partsupp"))
        made = completion.partsupp(self.raw("lineitem"))
        return in_hundredths(made, "partsupp", 1)

    def all(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def register_views(self) -> None:
        """One temporary view per table, under the table's own name."""
        for name, df in self.all().items():
            df.createOrReplaceTempView(name)
