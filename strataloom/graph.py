"""The typed property graph: three DataFrames, their schemas, and checks of the structure.

Sentinels stand for unknown values (-1, '', []), so that equality joins stay free of nulls. Edges are one table by kind:
a query over several kinds is one filter, and a stored graph is partitioned by kind, so that such a filter prunes files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def _schema(fields: str, *more: tuple[str, T.DataType]) -> T.StructType:
    """A schema of "name kind, ..." and further fields; needs no running Spark."""
    plain = [T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in fields.split(","))]
    return T.StructType(plain + [T.StructField(n, k) for n, k in more])


PARAM = _schema("name string, type string, default_value string")
FILES = _schema("path string, lang string, size long, sha256 binary, modified_at timestamp, loc long, is_generated boolean, is_vendored boolean")
SYMBOLS = _schema(
    "id string, name string, file string, kind string, line long, line_end long, qualified_name string, return_type string, arity long, is_async boolean, "
    "is_override boolean, is_abstract boolean, is_static boolean, is_test_marker boolean, is_generated boolean, confidence double, doc_summary string, has_unresolved_override boolean",
    ("modifiers", T.ArrayType(T.StringType())), ("params", T.ArrayType(PARAM)),
)
EDGES = _schema(
    "kind string, src string, dst string, line long, ref_kind string, alias string, re_export boolean, is_type_only boolean, decorator_args string", ("imported_names", T.ArrayType(T.StringType()))
)
EDGE_KINDS = (
    "DEFINES", "CONTAINS", "CALLS", "CALLS_HEURISTIC", "REFERENCES", "MODULE_TYPED", "IMPORTS", "IMPORTS_NAMED",
    "EXTENDS", "IMPLEMENTS", "OVERRIDES", "DECORATES", "TESTED_BY",
)
EXTERNAL = "external"

_BLANK = {"string": "", "bigint": -1, "boolean": False, "double": 1.0}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns; the ones it lacks get their sentinel."""
    out = []
    for f in schema:
        kind = f.dataType.simpleString()
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif kind.startswith("array"):
            out.append(F.array().cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(_BLANK.get(kind)).cast(f.dataType).alias(f.name))
    return df.select(*out)


@dataclass(frozen=True)
class Graph:
    """files, symbols and edges; edges run between symbol ids, or from or to file paths, as their kind says."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    #: Makes the edges of some kinds alone, for edges that are computed: kind() asks it in place of filtering all.
    make: Callable[..., DataFrame] | None = None

    @staticmethod
    def of(files: DataFrame, symbols: DataFrame, edges: DataFrame, make: Callable[..., DataFrame] | None = None) -> Graph:
        return Graph(conform(files, FILES), conform(symbols, SYMBOLS), conform(edges, EDGES), make and (lambda *kinds, by=None: conform(make(*kinds, by=by), EDGES)))

    @staticmethod
    def from_rows(spark: SparkSession, symbols: list[tuple], edges: list[tuple], files: list[tuple] = ()) -> Graph:
        """A small graph of (id, name, file, kind, line, line_end), (kind, src, dst, line) and (path, lang) rows."""
        paths = list(files) or sorted({(s[2], s[2].rpartition(".")[2]) for s in symbols if s[2] != "<external>"})
        return Graph.of(
            spark.createDataFrame(paths, "path string, lang string"),
            spark.createDataFrame(symbols, "id string, name string, file string, kind string, line long, line_end long"),
            spark.createDataFrame(edges, "kind string, src string, dst string, line long"),
        )

    def kind(self, *kinds: str, by: str | None = None) -> DataFrame:
        """The edges of some kinds; by says which end they are to be joined at, for edges that are made with a shuffle anyway."""
        return (self.make(*kinds, by=by) if self.make else self.edges).where(F.col("kind").isin(*kinds))

    def plus(self, kind: str, rows: DataFrame) -> Graph:
        """This graph with rows (src, dst, ...) as its edges of a kind that it has none of."""
        rows = conform(rows.withColumn("kind", F.lit(kind)), EDGES)

        def make(*kinds: str, by: str | None = None) -> DataFrame:
            others = [k for k in kinds if k != kind]
            return rows if not others else self.kind(*others, by=by).union(rows) if kind in kinds else self.kind(*others, by=by)

        return Graph(self.files, self.symbols, self.edges.union(rows), make)

    def internal(self) -> DataFrame:
        return self.symbols.where(F.col("kind") != EXTERNAL)

    def ends(self, *kinds: str, src: DataFrame | None = None, dst: DataFrame | None = None, first: str = "src") -> DataFrame:
        """Edges between symbols with both ends' name, file and kind: src_*, dst_*.

        src and dst are the symbols that may stand there, all by default; columns `defs` and `ids` of theirs come along. The end that
        leaves fewer edges should be joined first.
        """

        def side(tag: str, symbols: DataFrame) -> DataFrame:
            return symbols.select(F.col("id").alias(tag), *(F.col(c).alias(f"{tag}_{c}") for c in ("name", "file", "kind", "line", "defs", "ids") if c in symbols.columns))

        sides = {"src": side("src", self.symbols if src is None else src), "dst": side("dst", self.symbols if dst is None else dst)}
        rows = self.kind(*kinds, by=first).select("src", "dst", F.col("kind").alias("edge"), "line", "ref_kind")
        for tag in sorted(sides, reverse=first == "src"):
            rows = rows.join(sides[tag], tag)
        return rows

    def subset_violations(self, inner: str, outer: str) -> DataFrame:
        """Edges of the inner kind that the outer kind lacks; none in a sound graph."""
        return self.kind(inner).select("src", "dst").subtract(self.kind(outer).select("src", "dst"))
