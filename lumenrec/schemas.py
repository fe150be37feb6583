"""Schemas of the tables that go in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAMED = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_L, _S, _D, _B, _V = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.ArrayType(T.FloatType())
PICTURE = _struct(medium=_S, large=_S)
SEASON = _struct(year=_L, season=_S)

#: An item of the catalogue as the service sends it.
CATALOGUE = _struct(
    id=_L, title=_S, synopsis=_S, mean=_D, popularity=_L, num_list_users=_L, num_scoring_users=_L, nsfw=_S, genres=NAMED, studios=NAMED,
    num_episodes=_L, average_episode_duration=_L, status=_S, rating=_S, source=_S, media_type=_S, created_at=_S, updated_at=_S,
    start_date=_S, end_date=_S, main_picture=PICTURE, start_season=SEASON,
)
SHORT_CATALOGUE = _struct(id=_L, title=_S, synopsis=_S)
LIST_STATUS = _struct(score=_L, status=_S, num_episodes_watched=_L, is_rewatching=_B)
USER_ITEMS = _struct(user_id=_L, id=_L, title=_S, score=_L, status=_S, episodes_watched=_L, rewatching=_B, seq=_L)
RESULT = _struct(id=_L, distance=_D, link=_S)


def page_of(item: T.StructType, status: T.StructType | None = None) -> T.StructType:
    """The envelope of a page: data, of nodes (and list states), and paging."""
    entry = _struct(node=item) if status is None else _struct(node=item, list_status=status)
    return _struct(data=T.ArrayType(entry), paging=T.MapType(_S, _S))


def vector_table(**dims: int) -> tuple[T.StructType, dict[str, int]]:
    """Schema of a collection, an id and a vector a field, and the dimensions that validate() holds it to."""
    return _struct(id=_L, **{name: _V for name in dims}), dims


def validate(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """df, failing at run time on the first row that has a vector of another size."""
    from pyspark.sql import functions as F

    for name, size in dims.items():
        right = F.size(name) == size
        df = df.withColumn(name, F.when(F.col(name).isNull() | right, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} has not {size} components")).cast(df.schema[name].dataType)))
    return df
