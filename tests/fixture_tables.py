"""Small tables of the algebra's tests."""

import datetime

R = [(0, 5), (1, 2), (1, 3), (2, 1), (2, 2), (3, 4), (4, 6)]
R1 = [(1, 2), (1, 3), (2, 1), (2, 2), (3, 4)]
DAYS = ["2018-01-01", "2016-12-01", "2018-01-23", "2017-10-05", "2018-01-01", "2018-09-01", "2018-01-01"]
R_DATE = [(datetime.date.fromisoformat(d), g) for d, g in zip(DAYS, [5, 2, 3, 1, 2, 4, 6])]
LOG = [(1, 4, 1), (2, 3, 2), (3, 4, 3), (4, 6, 1), (5, 6, 3)]
LOG_STR = [(1, 4, "foo"), (2, 3, "fizzbuzz"), (3, 4, "bar"), (4, 6, "foo"), (5, 6, "bar")]
R2 = [(0.01,), (5.0,), (34.42,), (0.88,), (-0.42,)]


def tables(spark):
    make = spark.createDataFrame
    return {
        "r": make(R, "f long, g long"),
        "s": make(R, "f long, g long"),
        "r1": make(R1, "f long, g long"),
        "r_date": make(R_DATE, "f date, g long"),
        "log": make(LOG, "counter long, succ long, id long"),
        "log_str": make(LOG_STR, "counter long, succ long, id string"),
        "r2": make(R2, "a double"),
        "unique_str": make([("a",), ("b",), ("c",)], "str_field string"),
        "ints": spark.range(10).toDF("x"),
    }
