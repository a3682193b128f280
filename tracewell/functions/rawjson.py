"""JSON values as their source spells them, canonical JSON, and names under known keys at any depth."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Bytes of texts that are scanned at a time; a scan takes some 40 bytes for each.
SCAN_BYTES = 1 << 20

Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


class Scan:
    """The structure of JSON texts that stand one after the other in bytes: strings, brackets and their depth, found at once for all.

    Texts have to be valid JSON for their own spans to be right; one that isn't doesn't touch the others.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        n, sizes = len(data), np.diff(offsets)
        quote = data == 34
        back = data == 92
        if back.any():
            at = np.arange(n, dtype=np.int32)
            plain = np.maximum.accumulate(np.where(back, -1, at))
            run = np.r_[np.int32(0), at[:-1] - plain[:-1]]
            run[offsets[:-1][sizes > 0]] = 0
            quote &= run % 2 == 0

        def within(flags: np.ndarray) -> np.ndarray:
            """Running sums that begin anew with each text."""
            sums = np.r_[np.int32(0), np.cumsum(flags, dtype=np.int32)]
            return sums[1:] - np.repeat(sums[offsets[:-1]], sizes)

        outside = (within(quote) & 1 == 0) & ~quote
        opening, closing = outside & np.isin(data, (91, 123)), outside & np.isin(data, (93, 125))
        self.depth = within(opening.astype(np.int8) - closing.astype(np.int8))
        self.commas, self.colons = np.flatnonzero(outside & (data == 44)), np.flatnonzero(outside & (data == 58))
        self.solid = np.flatnonzero(~np.isin(data, (32, 9, 10, 13)))

    def trimmed(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Spans:
        """Spans without white space at their ends; blank ones go."""
        if not len(self.solid):
            return row[:0], start[:0], end[:0]
        first = self.solid[np.minimum(np.searchsorted(self.solid, start), len(self.solid) - 1)]
        last = self.solid[np.maximum(np.searchsorted(self.solid, end) - 1, 0)] + 1
        good = (first >= start) & (last <= end) & (first < last)
        return row[good], first[good], last[good]

    def parts(self, spans: Spans, opening: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the span, start, end) of what stands between the commas of those spans that are such a container, whose inner depth is given."""
        row, start, end = spans
        kept = np.flatnonzero(self.data[start] == opening) if len(start) else np.zeros(0, np.int64)
        s, e = start[kept], end[kept]
        commas = self.commas[self.depth[self.commas] == depth]
        at = np.searchsorted(s, commas, "right") - 1
        inside = (at >= 0) & (commas < e[np.maximum(at, 0)]) if len(s) else np.zeros(len(commas), bool)
        commas, at = commas[inside], at[inside]
        begin, of = np.r_[s + 1, commas + 1], np.r_[np.arange(len(s)), at]
        order = np.argsort(begin, kind="stable")
        begin, of = begin[order], of[order]
        stop = np.r_[begin[1:] - 1, 0] if len(begin) else begin
        last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
        stop[last] = e[of[last]] - 1
        return self.trimmed(kept[of], begin, stop)

    def field(self, spans: Spans, name: str, depth: int) -> Spans:
        """The values of a key of those spans that are objects; of a key that comes again the last."""
        of, start, end = self.parts(spans, 123, depth)
        colons = self.colons[self.depth[self.colons] == depth]
        if not len(of) or not len(colons):
            return spans[0][:0], spans[1][:0], spans[2][:0]
        colon = colons[np.minimum(np.searchsorted(colons, start), len(colons) - 1)]
        key = np.frombuffer(name.encode(), np.uint8)
        good = (colon > start) & (colon < end) & (start + len(key) + 1 < end)
        for k, c in enumerate(np.r_[34, key, 34]):
            good &= self.data[np.minimum(start + k, len(self.data) - 1)] == c
        of, start, end = self.trimmed(of[good], colon[good] + 1, end[good])
        last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
        return spans[0][of[last]], start[last], end[last]

    def items(self, spans: Spans, depth: int) -> Spans:
        """The elements of those spans that are arrays."""
        of, start, end = self.parts(spans, 91, depth)
        return spans[0][of], start, end


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8), ends - ends[0]


def sliced(column: pa.Array, most: int = SCAN_BYTES) -> Iterator[pa.Array]:
    """A column of texts in slices of about `most` bytes, or of one text."""
    ends, begin = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while begin < len(column):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        yield column.slice(begin, end - begin)
        begin = end


def raw_spans(column: pa.Array, paths: dict[str, str]) -> pa.StructArray:
    """For each JSON text the values at paths, as spelled; see raw_values().  Texts are scanned by slices, so memory is bounded whatever a batch holds."""
    parts = [_raw_spans(part, paths) for part in sliced(column)]
    return pa.concat_arrays(parts) if parts else _raw_spans(column, paths)


def _raw_spans(column: pa.Array, paths: dict[str, str]) -> pa.StructArray:
    data, offsets = _buffers(column)
    n, scan = len(column), Scan(data, offsets)
    whole = scan.trimmed(np.arange(n), offsets[:-1], offsets[1:])
    text = data.tobytes()
    out = []
    for path in paths.values():
        spans, depth, ends = whole, 1, None
        for step in re.findall(r"\[\]|[^.\[\]]+", path):
            if step != "[]":
                spans = scan.field(spans, step, depth)
            else:
                row, start, stop = scan.items(spans, depth)
                ends = np.searchsorted(row, np.arange(n + 1))
                spans = (np.arange(len(row)), start, stop)
            depth += 1
        found: list[str | None] = [None] * (n if ends is None else int(ends[-1]))
        for k, s, e in zip(*(x.tolist() for x in spans), strict=True):
            found[k] = text[s:e].decode()
        values = pa.array(found, pa.string())
        out.append(values if ends is None else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values))
    return pa.StructArray.from_arrays(out, list(paths))


def raw_values(line: Column, **paths: str) -> Column:
    """A struct of values of a JSON text at paths like 'message.content' or 'message.content[].input', byte for byte as its source spells them.

    A path with [] gives an array with an entry for each element, null where the rest of the path leads
    nowhere; other paths give null then.  Keys are matched as they are spelled.  At most one [] may stand in a path.
    """
    kinds = StructType([StructField(k, ArrayType(StringType()) if "[]" in p else StringType()) for k, p in paths.items()])

    @F.arrow_udf(kinds)
    def values(column: pa.Array) -> pa.Array:
        return raw_spans(column, paths)

    return values(line)


_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029", "\x7f": "\x7f"}
_SPECIAL = re.compile("[<>&  ]")
_LONE = re.compile("[\ud800-\udfff]")


def _number(x: float) -> str:
    """A double as the shortest decimal that reads back, without an exponent from 1e-6 to below 1e21."""
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if 1e-6 <= abs(x) < 1e21:
        plain = format(Decimal(repr(x)), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    digits, _, power = repr(x).partition("e")
    return f"{digits.removesuffix('.0')}e{int(power):+d}" if abs(int(power)) < 10 else f"{digits.removesuffix('.0')}e{power[0]}{power[1:].lstrip('0')}"


def canonical(text: str) -> str:
    """JSON with keys sorted at all depths, no white space, numbers as doubles, and <, >, & and line separators escaped."""

    def spell(v: object) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{spell(k)}:{spell(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(spell, v)) + "]"
        if isinstance(v, float):
            return _number(v)
        if isinstance(v, str):
            v = _LONE.sub("�", v)
            return _SPECIAL.sub(lambda m: _ESCAPES[m[0]], json.dumps(v, ensure_ascii=False))
        return json.dumps(v)

    def double(digits: str) -> float:
        x = float(digits)
        if math.isinf(x):
            raise ValueError("number out of range")
        return x

    def no_constant(name: str) -> None:
        raise ValueError(name)

    return spell(json.loads(text, parse_int=double, parse_float=double, parse_constant=no_constant))


@F.arrow_udf(StringType())
def canonical_json(column: pa.Array) -> pa.Array:
    """JSON texts re-encoded as canonical() does; null for what isn't JSON, nests too deep or has numbers out of range."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(text)
        except (ValueError, RecursionError):
            return None

    return pa.array([one(x) for x in column.to_pylist()], pa.string())


#: Keys whose strings name files, and how a patch names one.
FILE_KEYS = "file|path|file_path|filename"
PATCH_FILE = r"(?dm)^\*\*\* (?:Add|Update|Delete) File: (.+)$"
_STRING = r'"(?:[^"\\]|\\.)*+"'


def file_names(body: Column) -> Column:
    """The file names in a call's input: strings, or arrays of nothing but strings, under known keys at any depth, and in patch headers of any string.

    body is a JSON text, or a JSON string that holds one, or any other text, which then counts as one string.  A JSON text is
    read as tokens: a key is a string before a colon, which no string can imitate, as its quotes would be escaped.
    """
    inner = F.when(F.ltrim(body).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), body, F.lit("}")), "v string")["v"])
    value = F.coalesce(inner, body, F.lit(""))
    valid = F.ltrim(value).rlike(r"^[\[{]") & F.try_parse_json(value).isNotNull()
    decoded = lambda tokens: F.from_json(F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]")), "array<string>")
    keyed = F.regexp_extract_all(value, F.lit(rf'(?<!\\)"(?i:{FILE_KEYS})"\s*:\s*({_STRING}|\[\s*{_STRING}(?:\s*,\s*{_STRING})*+\s*\])'), F.lit(1))
    named = F.flatten(F.transform(keyed, lambda k: decoded(F.regexp_extract_all(k, F.lit(f"({_STRING})"), F.lit(1)))))
    texts = F.when(valid, decoded(F.regexp_extract_all(value, F.lit(f"({_STRING})"), F.lit(1)))).otherwise(F.array(value))
    headers = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(PATCH_FILE), F.lit(1))))
    return F.array_distinct(F.concat(F.when(valid, F.coalesce(named, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), F.coalesce(headers, F.array().cast("array<string>"))))
