"""The value model: null, booleans, integers, floats, strings, lists and maps.

Integers lie within 2**53 - 1 of zero; an integral float in that range is that integer.
NULL in a column means absent; null as a value is the VARIANT null.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The limits of the data model.
SAFE, MAX_DEPTH, MAX_STRING, MAX_LITERAL, MAX_WIDTH = 2**53 - 1, 64, 1 << 20, 100, 10_000

ABSENT = object()


def unify(x: Any) -> Any:
    """A number in its one form; None for what is no value (NaN, infinities)."""
    if isinstance(x, bool) or not isinstance(x, int | float):
        return x
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return int(x) if x == int(x) and abs(x) <= SAFE else float(x)


def equal(a: Any, b: Any) -> bool:
    """Deep equality that never crosses kinds."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return type(a) is type(b) and a == b


def bounds(x: Any, room: int = MAX_DEPTH) -> str:
    """`depth` or `string_length` where a bound is broken, else an empty string."""
    if isinstance(x, str):
        return "string_length" if len(x.encode("utf-8", "surrogatepass")) > MAX_STRING else ""
    if isinstance(x, list | dict):
        if room <= 0:
            return "depth"
        inner = x if isinstance(x, list) else [*x.keys(), *x.values()]
        return next((r for r in (bounds(v, room - 1) for v in inner) if r), "")
    return ""


def digest(x: Any) -> bytes:
    """Structural SHA-256: a tag byte, then the payload; containers hash their children's digests."""
    u64 = lambda n: struct.pack(">Q", n)
    if x is None or isinstance(x, bool):
        body = bytes([0 if x is None else 2 if x else 1])
    elif isinstance(x, int):
        size = abs(x).to_bytes((abs(x).bit_length() + 7) // 8, "big")
        body = b"\x03" + bytes([x < 0]) + u64(len(size)) + size
    elif isinstance(x, float):
        body = b"\x04" + struct.pack(">d", x + 0.0)
    elif isinstance(x, str):
        raw = x.encode("utf-8", "surrogatepass")
        body = b"\x05" + u64(len(raw)) + raw
    elif isinstance(x, list):
        body = b"\x06" + u64(len(x)) + b"".join(map(digest, x))
    else:
        pairs = sorted(x.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))
        body = b"\x07" + u64(len(pairs)) + b"".join(digest(k) + digest(v) for k, v in pairs)
    return hashlib.sha256(body).digest()


def structural_hash(x: Any) -> str:
    return digest(x).hex()


def _number(x: float) -> str:
    """The shortest form that reads back, with an exponent below 1e-4 and from 1e21 on."""
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    point = len(digits) + exponent  # the decimal point's place
    if -4 <= point - 1 < 21:
        out = "0." + "0" * -point + text if point <= 0 else text[:point].ljust(point, "0") + ("." + text[point:] if len(text) > point else "")
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1:+03d}"
    out = "-" * sign + out
    return out if set(".e") & set(out) else out + ".0"


def render(x: Any) -> str:
    """Canonical JSON: sorted keys, no white space, minimal escapes."""
    if isinstance(x, float):
        return _number(x)
    if isinstance(x, list):
        return "[" + ",".join(map(render, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{render(k)}:{render(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
    if isinstance(x, str):
        short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
        return '"' + "".join(short.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in x) + '"'
    return json.dumps(x)


class Reject(ValueError):
    """An input that is no value, with the reason's token."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def number(literal: str) -> int | float:
    if len(literal) > MAX_LITERAL:
        raise Reject("number_literal_length")
    if re.fullmatch(r"-?\d+", literal):
        if abs(int(literal)) > SAFE:
            raise Reject("integer_range")
        return int(literal)
    value = float(literal)
    if math.isinf(value):
        raise Reject("overflow")
    return unify(value)


def ingest(text: str | bytes) -> Any:
    """JSON text to a value, or Reject. Malformed JSON is rejected as `syntax`."""

    def once(pairs):
        out = {}
        for k, v in pairs:
            if k in out:
                raise Reject("duplicate_key")
            out[k] = v
        return out

    def constant(_):
        raise Reject("syntax")

    try:
        text = text.decode("utf-8") if isinstance(text, bytes) else text
        got = json.loads(text, object_pairs_hook=once, parse_int=number, parse_float=number, parse_constant=constant)
    except RecursionError:
        raise Reject("depth") from None
    except Reject:
        raise
    except ValueError:
        raise Reject("syntax") from None
    reason = bounds(got)
    if reason:
        raise Reject(reason)
    if re.search("[\ud800-\udfff]", json.dumps(got, ensure_ascii=False)):
        raise Reject("surrogate")
    return got


def pointer(x: Any, path: str) -> Any:
    """RFC 6901 lookup; ABSENT on a miss."""
    if path == "":
        return x
    if not path.startswith("/"):
        return ABSENT
    for token in path[1:].split("/"):
        token = token.replace("~1", "/").replace("~0", "~")
        if isinstance(x, list) and re.fullmatch(r"0|[1-9]\d*", token) and int(token) < len(x):
            x = x[int(token)]
        elif isinstance(x, dict) and token in x:
            x = x[token]
        else:
            return ABSENT
    return x


def lookup(x: Any, path: list) -> Any:
    """String segments need a map, integer segments a list in range; ABSENT on a miss."""
    for seg in path:
        if isinstance(seg, int) and isinstance(x, list) and 0 <= seg < len(x):
            x = x[seg]
        elif isinstance(seg, str) and isinstance(x, dict) and seg in x:
            x = x[seg]
        else:
            return ABSENT
    return x


# The same on typed columns.


def _u64(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def _tag(code: str) -> Column:
    return F.unhex(F.lit(code))


def hash_string(c: Column) -> Column:
    return F.sha2(F.concat(_tag("05"), _u64(F.octet_length(c)), F.encode(c, "UTF-8")), 256)


def hash_integer(c: Column) -> Column:
    size = F.when(c == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.hex(F.abs(c.cast("long")))))
    return F.sha2(F.concat(_tag("03"), F.when(c < 0, _tag("01")).otherwise(_tag("00")), _u64(F.octet_length(size)), size), 256)


def hash_boolean(c: Column) -> Column:
    return F.sha2(F.when(c, _tag("02")).otherwise(_tag("01")), 256)


def hash_null() -> Column:
    return F.sha2(_tag("00"), 256)


def hash_list(*hashes: Column) -> Column:
    return F.sha2(F.concat(_tag("06"), _u64(F.lit(len(hashes))), *map(F.unhex, hashes)), 256)


def hash_map(entries: dict[str, Column]) -> Column:
    order = sorted(entries, key=lambda k: k.encode())
    return F.sha2(F.concat(_tag("07"), _u64(F.lit(len(entries))), *[F.unhex(h) for k in order for h in (hash_string(F.lit(k)), entries[k])]), 256)


def unified_integer(c: Column) -> Column:
    """The integer form of a double column; NULL where it has none."""
    return F.when(~F.isnan(c) & (F.abs(c) <= float(SAFE)) & (c == F.floor(c)), c.cast("long"))


def unified(c: Column) -> Column:
    """A double column in its one form, as canonical JSON text; NULL where it is no value (NaN, infinities)."""
    whole = unified_integer(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.coalesce(whole.cast("string"), c.cast("string")))


def pointer_in(v: Column, path: str) -> Column:
    """RFC 6901 lookup in a VARIANT column; NULL on a miss. A key with a quote cannot be looked up there."""
    if path == "":
        return v
    if not path.startswith("/"):
        return F.lit(None).cast("variant")
    for token in path[1:].split("/"):
        token = token.replace("~1", "/").replace("~0", "~")
        if "'" in token:
            raise ValueError("a key with a quote cannot be looked up in a variant")
        found = F.try_variant_get(v, f"$['{token}']", "variant")
        if re.fullmatch(r"0|[1-9]\d*", token):
            found = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, f"$[{token}]", "variant")).otherwise(found)
        v = found
    return v


def bounds_of(v: Column) -> Column:
    """`string_length` where a string column is longer than the data model allows, else an empty string."""
    return F.when(F.octet_length(v) > MAX_STRING, "string_length").otherwise("")
