"""Row-wise helpers: Arrow batches in, annotated Arrow batches out, and the word rules in use."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and a space for every ASCII byte that is neither letter nor digit. UTF-8 bytes from 0x80 stay.
LOWER_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def name(column: str) -> str:
    """A column's name as an identifier, whatever characters it holds."""
    return "`" + column.replace("`", "``") + "`"


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, ASCII digits and anything beyond ASCII; null has none."""
    return text.translate(LOWER_WORDS).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space (0x20 and 0x09-0x0D); null has none."""
    return text.translate(LOWER).split() if text else []


def annotate(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list], Sequence]],
    fields: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
    binary: bool = True,
) -> DataFrame:
    """`row` (a struct of the kept columns; all of them by default) and the new `fields` for every row of df.

    make() runs once in a task and returns a function from a list of texts (bytes, or str if not binary; None
    for null) to one list or Arrow array for each field. Input columns stay inside `row`, so none can clash.
    """
    keep = list(df.columns if keep is None else keep)
    source = df.select(
        F.struct(*[F.col(name(c)) for c in keep]).alias("row") if keep else F.struct(F.lit(1).alias("one")).alias("row"),
        F.col(name(text)).cast("string").alias("text"),
    )
    schema = T.StructType([source.schema["row"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        do = make()
        for batch in batches:
            texts = batch.column(1)
            made = do((texts.cast(pa.binary()) if binary else texts).to_pylist())
            arrays = [batch.column(0)]
            for column, kind in zip(made, list(types)[1:], strict=True):
                arrays.append(column if isinstance(column, pa.Array) else pa.array(column, kind.type))
            yield pa.RecordBatch.from_arrays(arrays, names=types.names)

    return source.mapInArrow(run, schema)


def long(column: str) -> T.StructField:
    return T.StructField(column, T.LongType())


def string(column: str) -> T.StructField:
    return T.StructField(column, T.StringType())


def double(column: str) -> T.StructField:
    return T.StructField(column, T.DoubleType())


def structs(column: str, *fields: T.StructField) -> T.StructField:
    return T.StructField(column, T.ArrayType(T.StructType(list(fields))))
