from pyspark.sql import functions as F


def values(spark, inputs, schema, *exprs):
    """Evaluate columns over inline rows and give back tuples in input order."""
    rows = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"_i int, {schema}")
    out = df.select("_i", *[e.alias(f"c{n}") for n, e in enumerate(exprs)]).orderBy("_i").collect()
    return [r[1] if len(exprs) == 1 else tuple(r[1:]) for r in out]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def col(name):
    return F.col(name)
