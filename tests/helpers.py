import datetime as dt
import random

from logkeep.schemas import LOG_SCHEMA

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def message(topic, partition, offset, seconds=None, key=b"k", value=b"v", headers=()):
    return (topic, partition, offset, key, value, at(offset if seconds is None else seconds),
            list(headers))


def make_log(spark, rows):
    return spark.createDataFrame(rows, LOG_SCHEMA)


def same_rows(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def random_log(seed, sizes, gaps=True, disorder=0):
    """Messages of topics {name: size} with offset gaps and uneven, possibly late times."""
    rng = random.Random(seed)
    rows = []
    for (topic, partition), size in sizes.items():
        offset, clock = rng.randrange(100), 0
        for _ in range(size):
            clock += rng.choice([0, 0, 1, 1, 2, 5, 40])
            rows.append(message(topic, partition, offset, clock - rng.randrange(disorder + 1)))
            offset += rng.choice([1, 1, 1, 2, 9]) if gaps else 1
    rng.shuffle(rows)
    return rows
