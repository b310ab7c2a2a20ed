"""Scalar functions as column expressions."""

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text) -> Column:
    """UTF-16 code units, which is what clocks count for text."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def utf16_slice(text, start: Column, units: Column) -> Column:
    """A part of a text by code units; null where a cut would part a surrogate pair."""
    raw = F.encode(text, "UTF-16BE")
    part = F.substring(raw, (2 * start + 1).cast("int"), (2 * units).cast("int"))
    low = lambda at: F.substring(raw, (2 * at + 1).cast("int"), F.lit(1)).between(F.lit(b"\xdc"), F.lit(b"\xdf"))
    return F.when(low(start) | low(start + units), None).otherwise(F.decode(part, "UTF-16BE"))


def uuid5(space: str, name: Column) -> Column:
    """The version-5 UUID of a name in a name space (given as 32 hex digits)."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def document_id(name: Column, space: str) -> Column:
    """A name that is a UUID is its own id; any other has the UUID of its name."""
    return F.when(is_uuid(name), F.lower(name)).otherwise(uuid5(space, name))


def owner_id(owner: Column, space: str) -> Column:
    """As `document_id`; an empty owner is the nil UUID."""
    return F.when(F.coalesce(owner, F.lit("")) == "", F.lit("00000000-0000-0000-0000-000000000000")).otherwise(document_id(owner, space))


def parse_bytes(size: Column) -> Column:
    """Bytes of a size such as 512MB or 4GiB; KB and KiB are both 1024. Null if it is none."""
    number = F.regexp_extract(size, r"(?i)^\s*(\d+)\s*([KMGT]?)(I?B)?\s*$", 1)
    unit = F.upper(F.regexp_extract(size, r"(?i)^\s*(\d+)\s*([KMGT]?)(I?B)?\s*$", 2))
    power = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1)
    return F.when(number != "", F.try_to_number(number, F.lit("9" * 18)).cast("long") * power.cast("long"))


def result_class(status: Column) -> Column:
    """ok below 400, denied for 401 and 403, failed from 500, else refused."""
    return F.when(status < 400, "ok").when(status.isin(401, 403), "denied").when(status >= 500, "failed").otherwise("refused")


def fingerprint(secret: Column) -> Column:
    """The first four bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(secret, 256), 1, 8)


def update_key(payload: Column) -> Column:
    """A 128-bit key of an update, for matching what was sent with what arrived."""
    return F.substring(F.sha2(payload, 256), 1, 32)


def varuint_size(n: Column) -> Column:
    """Bytes of a non-negative number in groups of seven bits."""
    size = F.lit(8)
    for k in range(7, 0, -1):
        size = F.when(n < F.lit(1 << (7 * k)), k).otherwise(size)
    return size


def clean_reason(text: Column, most: int = 123) -> Column:
    """Control characters out, then at most so many bytes of its UTF-8, cut between characters."""
    clean = F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")
    raw = F.encode(clean, "UTF-8")
    # a byte 10xxxxxx goes on with the character before it
    inside = lambda at: F.substring(raw, at + 1, 1).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    end = F.lit(max(most - 3, 0))
    for back in range(min(2, most), -1, -1):
        end = F.when(~inside(most - back), F.lit(most - back)).otherwise(end)
    return F.when(F.octet_length(clean) <= most, clean).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def rfc3339(ts: Column, fraction: bool = False) -> Column:
    """A time as RFC 3339 in UTC (the session's zone); fractions of a second without trailing zeros."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.?0+$", "") if fraction else F.lit("")
    return F.concat(whole, part, F.lit("Z"))


def etag_matches(header: Column, etag: Column) -> Column:
    """Whether a header such as `"a", W/"b"` or `*` names the etag (given without quotes)."""
    names = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda x: F.regexp_replace(F.trim(x), r"^W/", ""))
    return F.exists(names, lambda x: (x == "*") | (x == F.concat(F.lit('"'), etag, F.lit('"'))))


def write_refused(permission: Column, payload: Column) -> Column:
    """Whether an update is refused: a reader may send an empty one only (two zero bytes: no structs, no deletions)."""
    return (F.coalesce(permission, F.lit("")) != "write") & ~F.coalesce(payload == F.lit(b"\x00\x00"), F.lit(False))


def delivery_outcome(status: Column, error: Column) -> Column:
    """(outcome, reason, retryable) of a delivery: an error of transport or a status; 408, 429 and 5xx are worth another try."""
    again = error.isNotNull() | status.isin(408, 429) | (status >= 500)
    sent = error.isNull() & status.between(200, 299)
    reason = F.when(sent, F.lit(None).cast("string")).when(error.isNotNull(), F.lit("transport")).when(status >= 500, F.lit("server_error")).when(status >= 400, F.lit("client_error")).otherwise(F.lit("unexpected_status"))
    return F.struct(F.when(sent, "sent").otherwise("failed").alias("outcome"), reason.alias("reason"), (again & ~sent).alias("retryable"))


def format_cursor(name: Column, doc_id: Column) -> Column:
    return F.concat(doc_id, F.lit("/"), name)


def parse_cursor(cursor: Column) -> Column:
    """(id, name) of a cursor; the first slash parts them."""
    parts = F.split(cursor, "/", 2)
    return F.struct(parts[0].alias("id"), parts[1].alias("name"))


def urlsafe_base64(raw: Column) -> Column:
    return F.rtrim(F.translate(F.base64(raw), "+/=", "-_ "))


def ipv4(text: Column) -> Column:
    """The number of an IPv4 address, also where it is written as ::ffff:1.2.3.4; null if it is none."""
    plain = F.regexp_extract(F.lower(text), r"^(?:::ffff:)?(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    p = F.split(plain, r"\.")
    parts = [F.try_element_at(p, F.lit(k + 1)).try_cast("long") for k in range(4)]
    good = plain != ""
    for x in parts:
        good &= F.coalesce(x <= 255, F.lit(False))
    return F.when(good, sum((x * (256 ** (3 - k)) for k, x in enumerate(parts)), F.lit(0).cast("long")))


def ipv6(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address; null if it is none."""
    low = F.lower(text)
    ends = F.split(low, "::", -1)
    groups = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ":", -1), lambda g: g != "")
    head, tail = groups(F.get(ends, 0)), groups(F.get(ends, 1))
    missing = 8 - F.size(head) - F.size(tail)
    full = F.when(F.size(ends) == 2, F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)).otherwise(head)
    shape = low.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(full) == 8) & F.forall(full, lambda g: F.length(g) <= 4) & ~low.contains(":::") & (F.size(ends) <= 2)
    return F.when(shape, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


#: The ranges that names stand for.
RANGES = {
    "loopback": ["127.0.0.0/8", "::1/128"],
    "private": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7"],
}


def in_cidr(address: Column, cidr: str) -> Column:
    """Whether an address lies in a block such as 10.0.0.0/8 or fc00::/7, in a named range, or is the given one."""
    if cidr in RANGES:
        each = [in_cidr(address, c) for c in RANGES[cidr]]
        return each[0] | each[1] if len(each) == 2 else F.exists(F.array(*each), lambda x: x)
    block = ipaddress.ip_network(cidr, strict=False)
    if block.version == 4:
        found = ipv4(address).between(int(block.network_address), int(block.broadcast_address))
    else:
        found = ipv6(address).between(f"{int(block.network_address):032x}", f"{int(block.broadcast_address):032x}")
    return F.coalesce(found, F.lit(False))


def client_ip(forwarded: Column, peer: Column, trusted: list[str]) -> Column:
    """The rightmost hop that no trusted proxy stands for; the peer itself if it is not trusted."""
    trusts = lambda a: F.exists(F.array(*[F.lit(False), *[in_cidr(a, c) for c in trusted]]), lambda x: x)
    hops = F.transform(F.reverse(F.split(F.coalesce(forwarded, F.lit("")), ",")), lambda h: F.trim(h))
    outside = F.filter(hops, lambda h: (h != "") & ~trusts(h))
    return F.when(~trusts(peer), peer).otherwise(F.coalesce(F.get(outside, F.lit(0)), peer))


def grant(doc: Column, token_doc: Column, permission: Column, expires: Column, now: Column, leeway: int = 30, not_before: Column | None = None, issued: Column | None = None, longest: int | None = None) -> Column:
    """read, write or null: what a token allows on a document; without a permission it may read. It may be valid later only, or be refused for a lifetime over `longest`."""
    held = (token_doc == doc) & (expires + leeway > now)
    if not_before is not None:
        held &= F.coalesce(not_before - leeway <= now, F.lit(True))
    if longest is not None:
        held &= F.coalesce(expires - (now if issued is None else issued) <= longest, F.lit(False))
    return F.when(held, F.coalesce(permission, F.lit("read")))


def token_expiry(token: Column) -> Column:
    """The `exp` of a token's payload; its signature is not checked."""
    body = F.translate(F.split(token, r"\.")[1], "-_", "+/")
    return F.get_json_object(F.try_to_binary(body, F.lit("base64")).cast("string"), "$.exp").cast("long")
