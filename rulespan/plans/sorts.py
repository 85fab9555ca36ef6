"""Sorts, and the Spark types of their values."""

from __future__ import annotations

from pyspark.sql import types as T

from ..functions.scalar import split_args
from .parser import ProgramError

BASE = {"i64": T.LongType(), "f64": T.DoubleType(), "String": T.StringType(), "bool": T.BooleanType(), "Unit": T.BooleanType(), "BigInt": T.DecimalType(38, 0)}


def spark_type(sort: str) -> T.DataType:
    """Of a sort's values; declared sorts are ids."""
    if sort in BASE:
        return BASE[sort]
    if sort == "BigRat":
        return T.StructType().add("num", BASE["BigInt"]).add("den", BASE["BigInt"])
    if "<" in sort:
        kind = sort.split("<", 1)[0]
        args = [spark_type(x) for x in split_args(sort)] if kind != "UnstableFn" else []
        if kind in ("Vec", "Set"):
            return T.ArrayType(args[0])
        if kind == "Pair":
            return T.StructType().add("a", args[0]).add("b", args[1])
        if kind == "Map":
            return T.ArrayType(T.StructType().add("k", args[0]).add("v", args[1]))
        if kind == "MultiSet":
            return T.ArrayType(T.StructType().add("v", args[0]).add("c", T.LongType()))
        if kind == "UnstableFn":
            # The function's name, and what it has been given already: text of each value.
            return T.StructType().add("f", T.StringType()).add("given", T.ArrayType(T.StringType()))
        raise ProgramError(f"no sort {sort}")
    return T.LongType()
