"""Small datasets of the scenarios that the engine's semantics are pinned on."""

import math

from keyloom import Schema

CARDNUM = [(1, 5172), (2, 2354), (3, 1410), (4, 1111), (5, 2354), (8, 4412)]
PERSON = [(1111, "Steve"), (1410, "Tom"), (2354, "Steve"), (6440, "Harry"), (5467, "Dick")]
FLOWS = [
    ("Cambridge", "London", 3.0), ("Cambridge", "Edinburgh", 2.4), ("Cambridge", "Oxford", 0.6), ("London", "Cambridge", 4.2), ("London", "Oxford", 2.4),
    ("Oxford", "London", 1.2), ("Oxford", "Edinburgh", 1.8), ("Edinburgh", "Cambridge", 1.8), ("Edinburgh", "London", 2.4),
]
CITIES = ("Cambridge", "Edinburgh", "London", "Oxford")


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows(df):
    """Rows as tuples with rounded numbers and lists as tuples, without order."""

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return tuple(map(plain, x)) if isinstance(x, list) else x

    return sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)


def flows(spark):
    s = Schema(spark)
    f = s.register(frame(spark, "from_city string, to_city string, volume double", FLOWS), ["from_city", "to_city"])
    city = s.create_class("City")
    s.blend(f["from_city"], f["to_city"], city)
    return s, city, f


def cards(spark):
    s = Schema(spark)
    c = s.register(frame(spark, "val_id long, cardnum long", CARDNUM), "val_id")
    p = s.register(frame(spark, "cardnum long, person string", PERSON), "cardnum")
    s.blend(c["cardnum"], p["cardnum"], s.create_class("Cardnum"))
    return s, c, p
