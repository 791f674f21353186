"""Joins of a user's own: a table function that sees the rows of both tables by key.

`join_hook` makes a table function of a callable and registers it. Its TABLE argument is
the union of both tables, which Spark deals by key and orders: by key, a key's side rows
in their order, then its base rows. The function gets the rows as Arrow batches of many
keys. The callable is called once for a key with the side rows; what it gives goes to
every base row of the key as it passes, so that only a key's side rows are held at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.conversion import ArrowTableToRowsConversion, LocalDataToArrowConversion
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.types import StructType

KEY, BASE, SIDE = "__key", "__base", "__side"
#: Groups of keys for each shuffle partition; a group is one PARTITION of the table function.
GROUPS = 16


def _changes(keys: pa.Array) -> np.ndarray:
    """Which keys but the first differ from the one before; nulls are equal, NaNs too."""
    if pa.types.is_nested(keys.type):
        rows = keys.to_pylist()
        return np.array([a != b for a, b in zip(rows[:-1], rows[1:], strict=True)], dtype=bool)
    a, b = keys[:-1], keys[1:]
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    if pa.types.is_floating(keys.type):
        differ &= ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    return differ


def join_hook(base: DataFrame, side: DataFrame, on: str, order: Sequence[str], resolve: Callable[[list], dict], result: StructType | str, name: str = "join_hook") -> DataFrame:
    """base with the columns of result, which resolve makes of the side rows of the same key, in their order.

    resolve gets the list of side rows (empty for a key without any, and for the null key) and gives a dict of the
    result's columns; it is called once for each key. Rows of base are kept as they are, repeated ones too. The
    function stays registered as `name`, so SQL can call it on any table of the same shape (__key, __base, __side):
    PARTITION BY a group of keys such as pmod(xxhash64(__key), 1000), ORDER BY (__key, __side IS NULL, what orders the side rows).
    """
    spark = base.sparkSession
    extra = StructType.fromDDL(result) if isinstance(result, str) else result
    clash = sorted(set(base.columns) & set(extra.names))
    if clash:
        raise ValueError(f"column names collide: {clash}")
    schema = StructType([*base.schema.fields, *extra.fields])
    names, added, held = list(base.columns), list(extra.names), side.schema

    class Hook:
        def __init__(self):
            # Of the key that came last: the key, side rows that wait for a base row, and what was made of them.
            self.key, self.rows, self.made = None, [], None

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            keys, bases, sides = (batch.column(c) for c in (KEY, BASE, SIDE))
            before = keys[:1] if self.key is None else self.key
            run = np.cumsum(_changes(pa.concat_arrays([before, keys])))  # 0: the key that came last
            self.key = keys[-1:]
            first = sides.is_null()
            own = run[first.to_numpy(zero_copy_only=False)]
            with_base, place = np.unique(own, return_inverse=True)
            listed = sides.filter(pc.invert(first))
            rows = ArrowTableToRowsConversion.convert(pa.Table.from_arrays(listed.flatten(), names=held.names), held)
            ends = np.cumsum(np.bincount(run[~first.to_numpy(zero_copy_only=False)], minlength=run[-1] + 1)).tolist()
            of = lambda k: (self.rows if k == 0 else []) + rows[ends[k - 1] if k else 0 : ends[k]]
            made = []
            for k in with_base.tolist():
                if k or self.made is None:
                    got = resolve(of(k))
                    made.append(tuple(got[c] for c in added))
                else:
                    made.append(self.made)
            last = int(run[-1])
            if len(with_base) and with_base[-1] == last:
                self.rows, self.made = [], made[-1]
            else:
                self.rows, self.made = of(last), None
            if made:
                new = LocalDataToArrowConversion.convert(made, extra, False).take(pa.array(place))
                yield pa.Table.from_arrays([*bases.filter(first).flatten(), *new.columns], names=[*names, *added])

    call = arrow_udtf(Hook, returnType=schema)
    spark.udtf.register(name, call)
    kind = lambda df: F.struct(*[F.col(c) for c in df.columns])
    left = base.select(F.col(on).alias(KEY), kind(base).alias(BASE), F.lit(None).cast(side.select(kind(side)).schema[0].dataType).alias(SIDE))
    right = side.where(F.col(on).isNotNull()).select(F.col(on).alias(KEY), F.lit(None).cast(base.select(kind(base)).schema[0].dataType).alias(BASE), kind(side).alias(SIDE))
    # Groups of keys, not single ones: each PARTITION costs a call and a batch of its own.
    group = F.pmod(F.xxhash64(KEY), F.lit(GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = left.unionByName(right).asTable().partitionBy(group).orderBy(F.col(KEY), F.col(SIDE).isNull(), *[F.col(f"{SIDE}.{c}") for c in order])
    return call(rows)
