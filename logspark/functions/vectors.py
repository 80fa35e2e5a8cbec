"""Column expressions over ``ARRAY<DOUBLE>`` vectors, and the hashing encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Divide by the length; a zero vector stays as it is."""
    length = norm(a)
    safe = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return let(safe, lambda n: F.transform(a, lambda x: x.cast("double") / n))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x
        )
    )


def cosine(a: Column, b: Column) -> Column:
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


#: Characters of a line that the encoder reads unless told otherwise.
ENCODED_CHARS = 1024


def line_template(line: Column, length: int | None = ENCODED_CHARS) -> Column:
    """The lower-case words, of any script, of the first ``length`` characters (null: of the whole line).

    Lines with one template have one vector.
    """
    read = line if length is None else F.substring(line, 1, length)
    return F.array_join(F.regexp_extract_all(F.lower(read), F.lit("([\\p{L}_]+)"), 1), " ")


def hash_vector(template: Column, dim: int = 64) -> Column:
    """Unit vector of hashed word counts of a template; no words give the zero vector."""
    tokens = F.filter(F.split(template, " "), lambda t: t != "")
    slots = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim)
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    counts = let(slots, lambda got: F.transform(places, lambda d: F.size(F.filter(got, lambda s: s == d)).cast("double")))
    return let(counts, l2_normalize)
