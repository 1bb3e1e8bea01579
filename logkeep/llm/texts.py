"""Words, bits and hashes of texts inside tasks."""

import itertools
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def as_bytes(column):
    """UTF-8 bytes of an Arrow text column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(kind).to_pylist()]


def text_runs(column, most):
    """(first row, UTF-8 bytes of the texts) of runs that hold at most ``most`` bytes or one text.

    Null counts as empty.
    """
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > first and held + size > most:
            yield first, as_bytes(column.slice(first, at - first))
            first, held = at, 0
        held += size
    if len(sizes) > first:
        yield first, as_bytes(column.slice(first))


def lower_words(text):
    """Words between ASCII white space, A-Z lower-cased (bytes)."""
    return text.lower().split()


def crc32_mod(ids, mod):
    """crc32 of each id as text, modulo; None for a null id."""
    return [None if i is None else zlib.crc32(str(i).encode()) % mod for i in ids]


def hash64(pieces):
    """XXH64 (seed 42) of each piece as uint64."""
    found = map(xxhash.xxh64_intdigest, pieces, itertools.repeat(42, len(pieces)))
    return np.fromiter(found, np.uint64, len(pieces))


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_BYTE_PLACES = 256 * np.arange(8)


def bit_sums(hashes, weights=None):
    """Sum of the weights (one each by default) of the hashes that have each bit set.

    Adds up the values of each of the eight bytes first, then the bits of the 256 values.
    """
    places = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + _BYTE_PLACES
    spread = None if weights is None else np.repeat(weights, 8)
    sums = np.bincount(places.reshape(-1), spread, minlength=2048).reshape(8, 256)
    return (sums @ _BYTE_BITS).reshape(-1)


def pack_rows(bits):
    """The uint64 of each row of 64 bits, highest bit first."""
    packed = np.packbits(bits.astype(np.uint8), axis=1)
    return packed.view(">u8").reshape(-1).astype(np.uint64)


def mix(values, seed):
    """Scramble uint64 values; equal values stay equal on every machine."""
    x = values ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_process(key, make):
    """A value made once per Python worker process and kept for its later tasks.

    Task functions travel by value, so what they keep must hang on a module of the process.
    """
    kept = sys.modules.setdefault("_logkeep_llm_kept", types.ModuleType("_logkeep_llm_kept"))
    if not hasattr(kept, "values"):
        kept.values = {}
    if key not in kept.values:
        kept.values[key] = make()
    return kept.values[key]


def hex64(values):
    return [f"{int(v):016x}" for v in values]


def small_batches(spark, rows=2_000):
    """Hand texts to Python tasks in batches of at most ``rows``: what a task holds is bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def struct_array(fields):
    """Arrow struct column from {name: array}."""
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
