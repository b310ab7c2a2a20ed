"""Merge of concurrent updates into documents.

`integrate` turns decoded structs and delete ranges into one row for each placed item, in document
order: Spark deals the rows by document, and one group is one document, whose size bounds a
task's memory. Everything that is read off a document (texts, maps, keys, state) is then relational, see
`views`.

The result does not depend on the order, batching or repetition of the rows. A struct whose
dependencies are missing is returned with `pending` true and takes no place.
"""

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.sources.staging import stage

ITEMS = "doc string, parent string, parent_sub string, position long, client long, clock long, len long, content_ref int, content string, deleted boolean, current boolean, kind string, pending boolean, origin struct<client: long, clock: long>, right_origin struct<client: long, clock: long>"
COUNTED = (2, 3, 4, 5, 7, 8, 9)


class Item:
    __slots__ = ("client", "clock", "len", "kind", "origin", "right_origin", "parent", "sub", "ref", "content", "left", "right", "deleted")

    def __init__(self, client, clock, length, kind, origin, right_origin, parent, sub, ref, content):
        self.client, self.clock, self.len, self.kind, self.origin, self.right_origin = client, clock, length, kind, origin, right_origin
        self.parent, self.sub, self.ref, self.content = parent, sub, ref, content
        self.left = self.right = None
        self.deleted = kind == "GC" or ref == 1


def cut_text(text: str, at: int) -> tuple[str, str]:
    """Two parts of a text, the first of `at` UTF-16 units; a cut inside a pair is refused."""
    raw = text.encode("utf-16-le", "surrogatepass")
    try:
        return raw[: 2 * at].decode("utf-16-le"), raw[2 * at :].decode("utf-16-le")
    except UnicodeDecodeError:
        raise ValueError("a cut would part a surrogate pair") from None


class Document:
    """Items by client, and the order of each parent's sequence or key."""

    def __init__(self):
        self.items: dict[int, list[Item]] = {}  # by client, in clock order, without gaps
        self.first: dict[tuple, Item] = {}  # (parent, sub) to the leftmost item
        self.queue: deque = deque()
        self.later: list[tuple] = []

    def state(self, client: int) -> int:
        own = self.items.get(client)
        return own[-1].clock + own[-1].len if own else 0

    def index(self, client: int, clock: int) -> int:
        own, low, high = self.items[client], 0, len(self.items[client])
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if own[mid].clock <= clock else (low, mid)
        return low

    def split(self, client: int, clock: int) -> Item:
        """The item that starts at the clock, cut off from the one before if need be."""
        at = self.index(client, clock)
        item = self.items[client][at]
        n = clock - item.clock
        if not n:
            return item
        if item.kind != "Item":
            rest = Item(client, clock, item.len - n, item.kind, None, None, None, None, item.ref, None)
        else:
            c, d = item.content or {}, None
            if item.ref == 4:
                a, b = cut_text(c["str"], n)
                c, d = {"str": a}, {"str": b}
            elif item.ref in (2, 8):
                c, d = {"values": c["values"][:n]}, {"values": c["values"][n:]}
            item.content = c
            rest = Item(client, clock, item.len - n, "Item", (client, clock - 1), item.right_origin, item.parent, item.sub, item.ref, d)
            rest.left, rest.right = item, item.right
            if item.right:
                item.right.left = rest
            item.right = rest
            rest.deleted = item.deleted
        item.len = n
        self.items[client].insert(at + 1, rest)
        return rest

    def find(self, of) -> Item:
        return self.items[of[0]][self.index(*of)]

    def add(self, s: Item) -> bool:
        """Place a struct; False while something that it needs is missing."""
        known = self.state(s.client)
        if s.clock + s.len <= known or s.kind == "Skip":
            return True
        needed = [x for x in (s.origin, s.right_origin, s.parent[1:] if s.parent and s.parent[0] == "item" else None) if x]
        if s.clock > known or any(x[1] >= self.state(x[0]) and x[0] != s.client for x in needed):
            return False
        if s.clock < known:
            n, rest = known - s.clock, s.content
            if s.ref == 4:
                rest = {"str": cut_text(rest["str"], n)[1]}
            elif s.ref in (2, 8):
                rest = {"values": rest["values"][n:]}
            s = Item(s.client, known, s.len - n, s.kind, (s.client, known - 1) if s.kind == "Item" else None, s.right_origin, s.parent, s.sub, s.ref, rest)
        if s.kind == "Item":
            self.place(s)
        self.items.setdefault(s.client, []).append(s)
        return True

    def place(self, s: Item):
        if s.origin:
            at = self.find(s.origin)
            if s.origin[1] + 1 < at.clock + at.len:
                self.split(s.origin[0], s.origin[1] + 1)
            s.left = self.find(s.origin)
        if s.right_origin:
            s.right = self.split(*s.right_origin)
        around = [x for x in (s.left, s.right) if x]
        if any(x.kind != "Item" for x in around):  # a neighbour is gone for good, and the place with it
            s.kind, s.left, s.right, s.deleted = "GC", None, None, True
            return
        if s.parent is None and around:
            s.parent, s.sub = around[0].parent, around[0].sub
        if s.parent is None or s.parent[0] == "item" and self.find(s.parent[1:]).kind != "Item":
            s.kind, s.left, s.right, s.deleted = "GC", None, None, True
            return
        key = (s.parent, s.sub)
        if (not s.left and (not s.right or s.right.left)) or (s.left and s.left.right is not s.right):
            o = s.left.right if s.left else self.first.get(key)
            before, level = set(), set()
            while o is not None and o is not s.right:
                before.add(id(o))
                level.add(id(o))
                if o.origin == s.origin:
                    if o.client < s.client:
                        s.left = o
                        level.clear()
                    elif o.right_origin == s.right_origin:
                        break
                elif o.origin is not None and id(self.find(o.origin)) in before:
                    if id(self.find(o.origin)) not in level:
                        s.left = o
                        level.clear()
                else:
                    break
                o = o.right
        s.right = s.left.right if s.left else self.first.get(key)
        if s.left:
            s.left.right = s
        else:
            self.first[key] = s
        if s.right:
            s.right.left = s
        if s.sub is not None:
            if s.right is None and s.left:
                s.left.deleted = True
            if s.right is not None:
                s.deleted = True
        if s.parent[0] == "item" and self.find(s.parent[1:]).deleted:
            s.deleted = True

    def delete(self, client: int, clock: int, length: int):
        stop = min(clock + length, self.state(client))
        if stop < clock + length:
            self.later.append((client, max(stop, clock), clock + length - max(stop, clock)))
        while clock < stop:
            item = self.split(client, clock)
            if item.clock + item.len > stop:
                self.split(client, stop)
            item.deleted = True
            clock = item.clock + item.len

    def run(self, structs: list[Item], deletes: list[tuple]) -> list[Item]:
        """Place all structs that can be placed; those that cannot are returned."""
        by: dict[int, deque] = {}
        for s in sorted(structs, key=lambda s: (s.client, s.clock, -s.len)):
            by.setdefault(s.client, deque()).append(s)
        moved = True
        while moved:
            moved = False
            for own in by.values():
                while own and self.add(own[0]):
                    own.popleft()
                    moved = True
        for one in sorted(set(deletes)):
            self.delete(*one)
        return [s for own in by.values() for s in own]


def to_item(r) -> Item:
    pair = lambda x: None if x is None else (int(x["client"]), int(x["clock"]))
    owner = pair(r.parent_item)
    parent = ("item", *owner) if owner else ("root", r.parent_root) if isinstance(r.parent_root, str) else None
    content = json.loads(r.content) if isinstance(r.content, str) else None
    return Item(int(r.client), int(r.clock), int(r.len), r.kind, pair(r.origin), pair(r.right_origin), parent, r.parent_sub if isinstance(r.parent_sub, str) else None, None if pd.isna(r.content_ref) else int(r.content_ref), content)


def parent_name(parent) -> str | None:
    return None if parent is None else parent[1] if parent[0] == "root" else f"#{parent[1]}:{parent[2]}"


def merged_rows(doc, rows) -> list[tuple]:
    document = Document()
    structs = [to_item(r) for r in rows if r.kind in ("Item", "GC")]
    waiting = document.run(structs, [(int(r.client), int(r.clock), int(r.len)) for r in rows if r.kind == "Delete"])
    out, seen = [], set()
    text = lambda c: None if c is None else json.dumps(c)
    pair = lambda x: None if x is None else {"client": x[0], "clock": x[1]}
    for (parent, sub), item in document.first.items():
        position = 0
        while item is not None:
            seen.add(id(item))
            live = not item.deleted
            out.append((doc, parent_name(parent), sub, position, item.client, item.clock, item.len, item.ref, text(item.content), item.deleted, live and (sub is None or item.right is None), "Item", False, pair(item.origin), pair(item.right_origin)))
            position, item = position + 1, item.right
    out += [(doc, None, None, None, i.client, i.clock, i.len, i.ref, None, True, False, i.kind, False, None, None) for own in document.items.values() for i in own if id(i) not in seen]
    out += [(doc, parent_name(s.parent), s.sub, None, s.client, s.clock, s.len, s.ref, text(s.content), False, False, s.kind, True, pair(s.origin), pair(s.right_origin)) for s in waiting]
    return out + [(doc, None, None, None, c, at, n, None, None, True, False, "Delete", True, None, None) for c, at, n in document.later]


def integrate(structs: DataFrame) -> DataFrame:
    """Decoded structs (as `codec.decode_updates` gives them) to placed items, see ITEMS.

    One shuffle deals and sorts the rows by document; a task then holds one document at a time. Rows with
    an error or without a document are left out.
    """
    columns = ["doc", "parent", "parent_sub", "position", "client", "clock", "len", "content_ref", "content", "deleted", "current", "kind", "pending", "origin", "right_origin"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({k: "Int64" for k in ("position", "client", "clock", "len", "content_ref")})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, out = None, {}, []
        for b in batches:
            for r in b.itertuples(index=False):
                if r.doc != at and held:
                    out += merged_rows(at, list(held.values()))
                    held = {}
                    if len(out) >= 10_000:
                        yield frame(out)
                        out = []
                at = r.doc
                held.setdefault((r.client, r.clock, r.len, r.kind), r)  # a struct that comes again is the same
        if held:
            out += merged_rows(at, list(held.values()))
        if out:
            yield frame(out)

    return structs.where("error is null and doc is not null").repartition("doc").sortWithinPartitions("doc").mapInPandas(work, ITEMS)


def placed(items: DataFrame) -> DataFrame:
    return items.where("not pending")


def live(items: DataFrame) -> DataFrame:
    return items.where("not pending and not deleted and kind = 'Item'")


def texts(items: DataFrame) -> DataFrame:
    """(doc, parent, text): the live strings of each sequence in order."""
    values = F.from_json(F.get_json_object("content", "$.values"), "array<string>")
    said = F.when(F.col("content_ref") == 4, F.get_json_object("content", "$.str")).when(F.col("content_ref") == 8, F.array_join(values, ""))
    pieces = F.sort_array(F.collect_list(F.struct("position", said.alias("said"))))
    return live(items).where("parent_sub is null and content_ref in (4, 8)").groupBy("doc", "parent").agg(F.array_join(F.transform(pieces, lambda p: p["said"]), "").alias("text"))


def maps(items: DataFrame) -> DataFrame:
    """(doc, parent, key, content_ref, content): the current value of each key."""
    return live(items).where("parent_sub is not null and current").select("doc", "parent", F.col("parent_sub").alias("key"), "content_ref", "content")


def current_writes(structs: DataFrame) -> DataFrame:
    """(doc, parent, key, content_ref, content): the current value of each key, from decoded structs and without placing them.

    For maps as peers write them: a write's origin is the write that it replaces, and nothing is to its right. Then the writes of a
    key are a forest, the greatest client's (of these its first) is the last of those with one origin, and the current write is
    the one at which a walk down these ends. Per origin an aggregation leaves one write; pointers to the next one are doubled
    until each key's walk is over, so that the steps are as many as the logarithm of its writes, and neither a document nor a key needs to
    fit a task. Structs that wait for others must be left out before (`intervals.pending`); a write in a deleted range goes.
    """
    from loomlog.operators.intervals import covering, merge_ranges

    given = structs.where("error is null and doc is not null")
    write = F.struct("client", F.expr("clock + len - 1").alias("clock"), "content_ref", "content").alias("write")
    order = F.struct("client", -F.col("clock"))
    sets = given.where("kind = 'Item'")
    owner = F.coalesce(F.concat(F.lit("#"), "parent_item.client", F.lit(":"), "parent_item.clock"), "parent_root").alias("parent")
    firsts = sets.where("origin is null and parent_sub is not null").select("doc", owner, F.col("parent_sub").alias("key"), write, order.alias("o"))
    at = stage(firsts.groupBy("doc", "parent", "key").agg(F.max_by("write", "o").alias("write")), "key-writes")
    after = sets.where("origin is not null").select(F.col("doc").alias("d"), F.struct("origin.client", "origin.clock").alias("of"), write, order.alias("o"))
    after = stage(after.groupBy("d", "of").agg(F.max_by("write", "o").alias("to")), "next-writes")
    here = lambda c: F.struct(f"{c}.client", f"{c}.clock")
    while True:
        moved = at.join(after, (F.col("doc") == F.col("d")) & (here("write") == F.col("of")), "left")
        moved = stage(moved.select("doc", "parent", "key", F.coalesce("to", "write").alias("write"), F.col("to").isNotNull().alias("moved")), "key-writes")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
        beyond = after.select(F.col("d").alias("e"), F.col("of").alias("via"), F.col("to").alias("beyond"))
        after = stage(after.join(beyond, (F.col("d") == F.col("e")) & (here("to") == F.col("via")), "left").select("d", "of", F.coalesce("beyond", "to").alias("to")), "next-writes")
    gone = merge_ranges(given.where("kind = 'Delete'").select("doc", "client", "clock", "len"))
    found = at.select("doc", "parent", "key", "write.content_ref", "write.content", "write.client", F.col("write.clock").alias("at"))
    return covering(found, gone, "left_anti").select("doc", "parent", "key", "content_ref", "content")


def map_keys(items: DataFrame) -> DataFrame:
    """(doc, parent, keys, n)."""
    return keys_of(maps(items))


def keys_of(values: DataFrame) -> DataFrame:
    """(doc, parent, keys, n) of `maps` or `current_writes`."""
    return values.groupBy("doc", "parent").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.count_distinct("key").alias("n"))


def roots(items: DataFrame) -> DataFrame:
    return placed(items).where("parent is not null and parent not like '#%'").select("doc", F.col("parent").alias("root")).distinct()


def subdocuments(items: DataFrame, current: bool = True) -> DataFrame:
    """(doc, guids): the documents that live items embed; those of keys only where they are the current value."""
    return live(items).where("content_ref = 9" + (" and current" if current else "")).groupBy("doc").agg(F.sort_array(F.collect_set(F.get_json_object("content", "$.guid"))).alias("guids"))


def text_lengths(items: DataFrame) -> DataFrame:
    """(doc, parent, units): countable live units of each sequence."""
    return live(items).where(F.col("content_ref").isin(*COUNTED) & F.col("parent_sub").isNull()).groupBy("doc", "parent").agg(F.sum("len").alias("units"))


def deleted_ranges(items: DataFrame) -> DataFrame:
    """What a peer must be told is deleted: deleted items, collected ones and ranges not yet known."""
    from loomlog.operators.intervals import merge_ranges

    return merge_ranges(items.where("deleted").select("doc", "client", "clock", "len"))


def fingerprints(items: DataFrame) -> DataFrame:
    """(doc, fingerprint): a digest of content, state and deletes, not of how they were batched."""
    from loomlog.operators.intervals import state_vector

    known = state_vector(placed(items)).select("doc", F.concat_ws(":", F.lit("s"), "client", "state").alias("x"))
    gone = deleted_ranges(items).select("doc", F.concat_ws(":", F.lit("d"), "client", "clock", "len").alias("x"))
    said = texts(items).select("doc", F.concat_ws(":", F.lit("t"), "parent", "text").alias("x"))
    value = F.when(F.col("content_ref") == 9, F.get_json_object("content", "$.guid")).otherwise(F.col("content"))
    held = maps(items).select("doc", F.concat_ws(":", F.lit("m"), "parent", "key", value).alias("x"))
    return known.unionAll(gone).unionAll(said).unionAll(held).groupBy("doc").agg(F.md5(F.array_join(F.sort_array(F.collect_list("x")), "\n")).alias("fingerprint"))


def describe(items: DataFrame) -> DataFrame:
    """(doc, body): a JSON view of each document's roots, keys, texts and subdocuments."""
    t = texts(items).select("doc", F.col("parent").alias("root"), "text")
    k = map_keys(items).select("doc", F.col("parent").alias("root"), "keys")
    each = roots(items).join(t, ["doc", "root"], "left").join(k, ["doc", "root"], "left")
    rows = each.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("root").alias("name"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys")))).alias("roots"))
    body = rows.join(subdocuments(items), "doc", "left").select("doc", F.to_json(F.struct(F.col("doc").alias("name"), "roots", F.coalesce("guids", F.array().cast("array<string>")).alias("subdocs"))).alias("body"))
    return body


def _owner(parent: str) -> tuple | None:
    """The owning item of a parent name such as #7:3, None for a root."""
    if not parent.startswith("#"):
        return None
    client, _, clock = parent[1:].partition(":")
    return int(client), int(clock)


def encode(items: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(doc, payload): each document as one update, or what a peer with the state vector lacks of it.

    vectors: (doc, client, state). Structs are filtered by the vector and the first one is sliced; the
    deleted ranges always go along. What is pending is not part of a document's state.
    """
    from loomlog.functions.codec import unplain, write_update  # functions, since a module with used UDFs cannot travel

    known = None if vectors is None else vectors.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("client", "state"))).alias("known"))
    rows = items.join(known, "doc", "left") if known is not None else items.withColumn("known", F.lit(None).cast("map<long, long>"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        structs, deletes, states = [], {}, {}
        pair = lambda x: None if x is None else (int(x["client"]), int(x["clock"]))
        for r in pdf.sort_values(["client", "clock"]).itertuples(index=False):
            client, clock, n = int(r.client), int(r.clock), int(r.len)
            if r.deleted:
                own = deletes.setdefault(client, [])
                if own and own[-1][0] + own[-1][1] >= clock:
                    own[-1][1] = max(own[-1][1], clock + n - own[-1][0])
                else:
                    own.append([clock, n])
            if r.pending:
                continue
            held = dict(r.known) if r.known is not None else {}
            skip = max(int(held.get(client, 0)) - clock, 0)
            states[client] = clock + n
            if skip >= n:
                continue
            s = {"client": client, "clock": clock + skip, "kind": r.kind, "len": n - skip, "origin": pair(r.origin), "right": pair(r.right_origin), "root": None, "owner": None, "sub": r.parent_sub if isinstance(r.parent_sub, str) else None, "ref": None, "content": None}
            if r.kind == "Item":
                c, ref = unplain(json.loads(r.content)), int(r.content_ref)
                if skip:
                    s["origin"] = (client, clock + skip - 1)
                    c = {"len": n - skip} if ref == 1 else {"str": cut_text(c["str"], skip)[1]} if ref == 4 else {"values": c["values"][skip:]}
                owner = _owner(r.parent)
                s |= {"ref": ref, "content": c, "owner": owner, "root": None if owner else r.parent}
                if s["origin"] or s["right"]:
                    s["sub"] = None  # taken over from the neighbour
            structs.append(s)
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "payload": [write_update(structs, deletes)]})

    return rows.groupBy("doc").applyInPandas(one, "doc string, payload binary")


def to_json(items: DataFrame) -> DataFrame:
    """(doc, root, body): each root as JSON, with the types nested in it.

    A type with keys is an object, any other a list of its values; a text is a string. One group is one document.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lists: dict[str, list] = {}
        keys: dict[str, dict] = {}
        for r in pdf.sort_values("position").itertuples(index=False):
            if isinstance(r.parent_sub, str):
                if r.current:
                    keys.setdefault(r.parent, {})[r.parent_sub] = r
            else:
                lists.setdefault(r.parent, []).append(r)

        def values(r) -> list:
            c, ref = json.loads(r.content), int(r.content_ref)
            if ref in (2, 8):
                return [json.loads(x) for x in c["values"]] if ref == 2 else c["values"]
            if ref == 7:
                return [render(f"#{int(r.client)}:{int(r.clock)}", c["type"])]
            if ref == 5:
                return [json.loads(c["json"])]
            if ref == 9:
                return [{"$subdoc": c["guid"]}]
            return [c["str"]] if ref == 4 else [c.get("bytes")] if ref == 3 else []

        def render(parent: str, kind: int | None):
            own = lists.get(parent, [])
            if kind == 1 or kind is None and not own:
                return {k: values(r)[-1] for k, r in sorted(keys.get(parent, {}).items()) if values(r)}
            found = [v for r in own for v in values(r)]
            text = kind in (2, 6) or kind is None and any(int(r.content_ref) == 4 for r in own)
            return "".join(v for v in found if isinstance(v, str)) if text else found

        names = sorted({p for p in (*lists, *keys) if not p.startswith("#")})
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]] * len(names), "root": names, "body": [json.dumps(render(n, None), sort_keys=True, ensure_ascii=False) for n in names]})

    return live(items).groupBy("doc").applyInPandas(one, "doc string, root string, body string")


def load(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, skipped) of a log of payloads (doc, seq, payload): rows that do not parse are counted, not fatal."""
    from loomlog.functions import codec

    decoded = codec.decode_updates(log)
    skipped = decoded.groupBy("doc").agg(F.count_if(F.col("error").isNotNull()).alias("skipped"))
    return integrate(decoded), skipped
