"""Deterministic generators on spark.range: the same seed gives the same rows at any parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, name: str, most: int, index: Column) -> Column:
    """A number of 0 to most - 1 from seed, name and index."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), index), F.lit(most)).cast("long")


def arithmetic(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """id, question, answer, verifier: sums, differences and products."""
    i = F.col("id")
    a, b, op = draw(seed, "a", 1000, i), draw(seed, "b", 1000, i), draw(seed, "op", 3, i)
    sign = F.when(op == 0, "+").when(op == 1, "-").otherwise("*")
    value = F.when(op == 0, a + b).when(op == 1, a - b).otherwise(a * b)
    return spark.range(count).select(F.concat(F.lit(f"arith-{seed}-"), i).alias("id"), F.concat(F.lit("What is "), a, F.lit(" "), sign, F.lit(" "), b, F.lit("?")).alias("question"), value.cast("string").alias("answer"), F.lit("integer").alias("verifier"))


def gcd(x: Column, y: Column) -> Column:
    """Greatest common divisor of numbers from 0 to 2^16: Euclid ends within 24 steps."""
    pair = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    step = lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % F.when(p["y"] == 0, 1).otherwise(p["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), pair, step, lambda p: p["x"])


def _drawn(spark: SparkSession, count: int, seed: int) -> DataFrame:
    return spark.range(count).select("id", *[(draw(seed, n, 89, F.col("id")) + 1).alias(n) for n in ("a", "b", "c", "d")])


def fraction_documents(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """id, text, num, den: sums of two fractions in lowest terms, kept as whole numbers."""
    rows = _drawn(spark, count, seed).withColumn("n", F.expr("a * d + c * b")).withColumn("m", F.expr("b * d"))
    rows = rows.withColumn("g", gcd(F.col("n"), F.col("m")))
    return rows.select(F.concat(F.lit(f"frac-{seed}-"), "id").alias("id"), F.expr("concat(a, '/', b, ' + ', c, '/', d, ' = ', cast(n div g as bigint), '/', cast(m div g as bigint))").alias("text"), F.expr("n div g").alias("num"), F.expr("m div g").alias("den"))


#: Kinds of problems: text of the question and value, both of whole numbers a, b, c, d of 1 to 89.
PROBLEMS = {
    "divisor": ("concat('The greatest common divisor of ', a * c, ' and ', b * c)", "g"),
    "mean": ("concat('The mean of ', a, ', ', b, ', ', c, ' and ', 4 * d - a - b - c)", "d"),
    "polynomial": ("concat('The value of ', a, 'x^2 + ', b, 'x + ', c, ' at x = ', d)", "a * d * d + b * d + c"),
    "equation": ("concat('The x with ', a, 'x + ', b, ' = ', a * c + b)", "c"),
    "remainder": ("concat('The remainder of ', a * b + c, ' after division by ', d)", "(a * b + c) % d"),
    "percent": ("concat(a, ' percent of ', 100 * b)", "a * b"),
}


def math_documents(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """id, kind, text, value, check: problems of PROBLEMS in turn, whole values only.

    check is what must hold of a value whatever the numbers: a divisor divides both, a mean times
    their number is the sum, a root solves, a remainder lies below the divisor.
    """
    rows = _drawn(spark, count, seed).withColumn("k", F.col("id") % len(PROBLEMS)).withColumn("g", gcd(F.expr("a * c"), F.expr("b * c")))
    pick = lambda i: F.element_at(F.array(*[F.expr(v[i]).cast("long" if i else "string") for v in PROBLEMS.values()]), (F.col("k") + 1).cast("int"))
    out = rows.withColumn("text", pick(0)).withColumn("value", pick(1)).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in PROBLEMS]), (F.col("k") + 1).cast("int")))
    check = {
        "divisor": "(a * c) % value = 0 and (b * c) % value = 0 and value % c = 0", "mean": "4 * value = a + b + c + (4 * d - a - b - c)", "polynomial": "(value - c) % d = 0",
        "equation": "a * value + b = a * c + b", "remainder": "value between 0 and d - 1 and (a * b + c - value) % d = 0", "percent": "100 * value = a * 100 * b",
    }
    held = F.lit(False)
    for kind, rule in check.items():
        held = F.when(F.col("kind") == kind, F.expr(rule)).otherwise(held)
    return out.select(F.concat(F.lit(f"math-{seed}-"), "id").alias("id"), "kind", F.concat("text", F.lit(" is "), F.col("value").cast("string"), F.lit(".")).alias("text"), "value", held.alias("check"))


def diagnostics(spark: SparkSession, images: int, texts: int, seed: int) -> DataFrame:
    """id, domain, split, label: rows of an image and a text domain for smoke runs."""
    i = F.col("id")
    of = lambda n, d: spark.range(n).select(F.concat(F.lit(f"{d}-{seed}-"), i).alias("id"), F.lit(d).alias("domain"), F.when(draw(seed, "split", 10, i) == 0, "val").otherwise("train").alias("split"), draw(seed, d, 4, i).alias("label"))
    return of(images, "image").unionByName(of(texts, "text"))
