"""Scalars for media ranges, provider streams, addresses, highlights and test embeddings.

All are column expressions; null inputs give null (``public_url``: false).
"""

from __future__ import annotations

import ipaddress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.config import TRANSITIONS
from marginalia.functions.text import trimmed

DIM = 384  # fixed value: length of an embedding
WORD = 0xFFFFFFFF


def byte_range(header: Column, size: Column) -> Column:
    """struct<start,end> (both included) of a range header for ``size`` bytes; null if there is none that fits."""
    form = r"bytes=(\d{0,18})-(\d{0,18})"
    first, last = (F.regexp_extract(header, form, g).try_cast("long") for g in (1, 2))
    start = F.when(first.isNotNull(), first).otherwise(F.greatest(F.lit(0), size - last))
    end = F.when(first.isNotNull() & last.isNotNull(), F.least(last, size - 1)).otherwise(size - 1)
    fits = (first.isNotNull() | last.isNotNull()) & (size > 0) & (start < size) & (start <= F.coalesce(F.when(first.isNotNull(), last), size - 1))
    return F.when(fits, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))


def sse_data(line: Column) -> Column:
    """What follows ``data:`` on an event line, trimmed."""
    return F.when(F.ltrim(line).startswith("data:"), trimmed(F.regexp_replace(line, r"^\s*data:", "")))


def _string_at(json: Column, path: str) -> Column:
    """A JSON string that is not empty; null for all else."""
    found = F.try_variant_get(json, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.try_variant_get(json, path, "string"), F.lit("")))


def stream_delta(line: Column, dialect: Column) -> Column:
    """New text in one line of a provider's stream; ``dialect`` is ndjson, choices, blocks or parts."""
    json = F.try_parse_json(F.when(dialect == "ndjson", trimmed(line)).otherwise(sse_data(line)))
    parts = F.transform(F.try_variant_get(json, "$.candidates[0].content.parts", "array<variant>"), lambda p: F.coalesce(_string_at(p, "$.text"), F.lit("")))
    return (
        F.when(dialect == "ndjson", _string_at(json, "$.message.content"))
        .when(dialect == "choices", _string_at(json, "$.choices[0].delta.content"))
        .when(dialect == "blocks", F.when(_string_at(json, "$.type") == "content_block_delta", _string_at(json, "$.delta.text")))
        .when(dialect == "parts", F.nullif(F.array_join(parts, ""), F.lit("")))
    )


# Networks of this machine or its neighbours.
_INNER = [*map(ipaddress.ip_network, "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 ::/128 ::1/128 fc00::/7 fe80::/10".split())]


def _inner_v6(host: str) -> bool:
    """Whether an IPv6 address is an inner one or has an inner IPv4 address in it; what is no address counts as one."""
    try:
        ip = ipaddress.IPv6Address(host)
    except ValueError:
        return True
    embedded = int(ip) >> 32 in (0, 0xFFFF) and int(ip) & 0xFFFFFFFF != 0 and int(ip) != 1
    x = ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF) if embedded else ip
    return any(x in n for n in _INNER if n.version == x.version)


def public_url(url: Column) -> Column:
    """Whether an address is http(s) and its host no local name and no inner number.

    Hosts of digits, dots and hexadecimal numbers other than a plain IPv4 address are refused:
    a browser reads them as IPv4 addresses.  Bracketed hosts must be public IPv6 addresses.
    """
    host = F.lower(F.regexp_extract(url, r"^[hH][tT]{2}[pP][sS]?://(?:[^/?#@]*@)?([^/?#:\[\]\s]+|\[[^\]]*\])(?::\d{0,5})?(?:[/?#]|$)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    quad = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    a, b = quad[0], F.try_element_at(quad, F.lit(2))
    inside = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    plain = host.rlike(r"^(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})$") & F.forall(quad, lambda x: x <= 255)
    number_like = host.rlike(r"(?:^|\.)(?:0x[0-9a-f]*|\d+)$")  # the last part decides

    @F.arrow_udf("boolean")
    def outer_v6(hosts: pa.Array) -> pa.Array:
        return pa.array([h is not None and h.startswith("[") and not _inner_v6(h[1:-1]) for h in hosts.to_pylist()], pa.bool_())

    named = (host != "") & (host != "localhost") & ~host.endswith(".localhost")
    return F.coalesce(F.when(host.startswith("["), outer_v6(host)).otherwise(named & F.when(number_like, plain & ~inside).otherwise(True)), F.lit(False))


def transition_ok(before: Column, after: Column) -> Column:
    """Whether a source may go from one state to the other."""
    return F.concat_ws(">", before, after).isin(*(f"{a}>{b}" for a, b in TRANSITIONS))


def segments(size: Column, start: Column, end: Column, breaks: Column) -> Column:
    """array<struct<s,e,highlight,page>> of a text cut at a highlight and at array<struct<offset,page>>.

    A highlight outside the text or without length is ignored, and so are breaks outside it.
    """
    valid = F.coalesce((start >= 0) & (end <= size) & (start < end), F.lit(False))
    breaks = F.filter(F.coalesce(breaks, F.expr("cast(array() as array<struct<offset:int,page:bigint>>)")), lambda b: b["offset"].between(0, size))
    marks = F.concat(F.array(F.lit(0), size), F.when(valid, F.array(start, end)).otherwise(F.expr("cast(array() as array<int>)")), F.transform(breaks, lambda b: b["offset"]))
    at = F.array_sort(F.array_distinct(marks))

    def segment(s: Column, k: Column) -> Column:
        e = F.get(at, k + 1)
        page = F.element_at(F.map_from_arrays(F.transform(breaks, lambda b: b["offset"]), F.transform(breaks, lambda b: b["page"])), s)
        return F.struct(s.alias("s"), e.alias("e"), (valid & (s >= start) & (e <= end)).alias("highlight"), page.alias("page"))

    return F.filter(F.transform(at, segment), lambda x: x["e"].isNotNull())


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """Unit vector drawn from a hash (FNV-1a over UTF-16 units, then xorshift): a stand-in embedder for tests."""

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        h = np.full(len(texts), 2166136261, np.uint32)
        units = [np.frombuffer((t or "").encode("utf-16-le"), "<u2") for t in texts.to_pylist()]
        size = np.array(list(map(len, units)))
        for k in range(int(size.max(initial=0))):  # all texts advance together
            rows = np.flatnonzero(size > k)
            h[rows] = (h[rows] ^ np.array([units[r][k] for r in rows.tolist()], np.uint32)) * np.uint32(16777619)
        drawn = np.zeros((len(h), dim))
        for k in range(dim):
            h ^= h << np.uint32(13)
            h ^= h >> np.uint32(17)
            h ^= h << np.uint32(5)
            drawn[:, k] = h / WORD * 2 - 1
        norm = np.sqrt((drawn * drawn).sum(1, keepdims=True))
        drawn = np.divide(drawn, norm, out=drawn, where=norm > 0)
        offsets = pa.array(np.arange(len(h) + 1) * dim, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(drawn.ravel()), mask=texts.is_null())

    return embed(text)
