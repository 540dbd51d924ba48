from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)
