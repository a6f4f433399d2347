"""Table contracts: ordered columns of text or double, primary keys, strict normalisation and validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


class ContractError(ValueError):
    """A frame breaks its table's contract."""


@dataclass(frozen=True)
class Contract:
    """columns in order; those in `text` are strings, all others doubles; `key` is unique and never NULL."""

    columns: tuple[str, ...]
    text: tuple[str, ...]
    key: tuple[str, ...] = ()

    def kind(self, column: str):
        return StringType() if column in self.text else DoubleType()

    def schema(self) -> StructType:
        return StructType([StructField(c, self.kind(c), c not in self.key) for c in self.columns])

    def normalize(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """Columns in order and of their types, missing ones NULL; extra ones are an error if strict, else dropped. NaN becomes NULL."""
        extra = [c for c in df.columns if c not in self.columns]
        if strict and extra:
            raise ContractError(f"columns not in the contract: {extra}")
        out = []
        for c in self.columns:
            x = (F.col(c) if c in df.columns else F.lit(None)).cast(self.kind(c))
            out.append((x if c in self.text else F.when(~F.isnan(x), x)).alias(c))
        return df.select(*out)

    def validate(self, df: DataFrame) -> DataFrame:
        """The frame, if its columns, types and key hold (one aggregation)."""
        if [(f.name, f.dataType) for f in df.schema] != [(c, self.kind(c)) for c in self.columns]:
            raise ContractError(f"schema differs: {df.schema.simpleString()}")
        if self.key:
            null = F.lit(False)
            for k in self.key:
                null = null | F.col(k).isNull()
            # grouped first, so that the count of keys is a partial aggregate and never one task's set
            row = df.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count_if(null).alias("nulls")).first()
            if row["nulls"] or (row["most"] or 0) > 1:
                raise ContractError(f"key {self.key} is NULL {row['nulls']} times, or repeats")
        return df

    def empty(self, spark) -> DataFrame:
        return spark.createDataFrame([], self.schema())
