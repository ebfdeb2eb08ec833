"""Rankings as table functions: for SQL, over a partitioned and ordered table argument."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException


class CandidateRun:
    """candidate_run(TABLE(scored) PARTITION BY query_id ORDER BY score DESC, doc_id, k): a row for each query with its first k
    rows packed, as candidates (rank and the table's other columns), and how many they are.

    The input has a column query_id; rows come as the ORDER BY has them, and what follows the k-th is not read.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("candidate_run takes a table")
        if not k.isConstantExpression or k.value is None or k.value < 1:
            raise ValueError("k is a constant of at least 1")
        fields = table.dataType.fields
        query = [f for f in fields if f.name == "query_id"]
        if not query:
            raise ValueError("the table has no column query_id")
        packed = StructType([StructField("rank", LongType()), *[f for f in fields if f.name != "query_id"]])
        return AnalyzeResult(StructType([query[0], StructField("n", LongType()), StructField("candidates", ArrayType(packed))]))

    def __init__(self, *_):
        self._query, self._rows = None, []

    def eval(self, row, k: int):
        if len(self._rows) >= k:
            raise SkipRestOfInputTableException("the run is full")
        own = row.asDict()
        self._query = own.pop("query_id")
        self._rows.append((len(self._rows) + 1, *own.values()))

    def terminate(self):
        if self._rows:
            yield self._query, len(self._rows), self._rows


def register(spark: SparkSession) -> SparkSession:
    """Make candidate_run known to the session's SQL."""
    spark.udtf.register("candidate_run", udtf(CandidateRun))
    return spark


def candidate_runs(scored: DataFrame, k: int) -> DataFrame:
    """candidate_run over (query_id, doc_id, score, ...) by score, ties to the smaller doc_id."""
    spark = register(scored.sparkSession)
    query = "SELECT * FROM candidate_run(TABLE(SELECT * FROM {scored}) PARTITION BY query_id ORDER BY (score DESC, doc_id), {k})"
    return spark.sql(query, scored=scored, k=k)
