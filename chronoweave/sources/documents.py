"""Documents held against tables of rules, so that every fault names its path.

A document is a VARIANT. It is walked level by level into one row for each node: its path, the pattern of that path
(places in lists and keys of free mappings are left open), its kind and its text. Each kind of rule is a table of
patterns, and checking is joining nodes with it, for any number of documents at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rules:
    """Tables of rules; `at` is a pattern such as sessions[*].start."""

    required: list[tuple[str, str]] = field(default_factory=list)  # at, key
    known: list[tuple[str, str]] = field(default_factory=list)  # at, key: all keys that a mapping may have
    kinds: list[tuple[str, str]] = field(default_factory=list)  # at, kinds: text number whole boolean list mapping
    shapes: list[tuple[str, str, str]] = field(default_factory=list)  # at, regular expression, what it stands for
    unique: list[str] = field(default_factory=list)  # at
    refers: list[tuple[str, str, str]] = field(default_factory=list)  # at, to, what is referred to
    one_of: list[tuple[str, str]] = field(default_factory=list)  # at, keys of which one is needed
    after: list[tuple[str, str, str]] = field(default_factory=list)  # at, key, key that has to be later or larger
    least: list[tuple[str, float]] = field(default_factory=list)  # at, number
    free: tuple[str, ...] = ()  # mappings whose keys are names of their own


def kind_of(value: Column | str) -> Column:
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT"), "mapping").when(schema.startswith("ARRAY"), "list").when(schema == "STRING", "text").when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null").when(schema == "BIGINT", "whole").otherwise("number")
    )


def nodes(docs: DataFrame, free: tuple[str, ...] = ()) -> DataFrame:
    """doc, path, pattern, above (the parent's path), above_pattern, key, kind and text of every node. docs: doc, text (JSON).

    A text that is no JSON is one node of the kind `broken`.
    """
    spark = docs.sparkSession
    root = docs.select("doc", F.lit("").alias("path"), F.lit("").alias("pattern"), F.lit(None).cast("string").alias("above"), F.lit(None).cast("string").alias("above_pattern"), F.lit(None).cast("string").alias("key"), F.try_parse_json("text").alias("value"))
    from chronoweave.session import cut_lineage

    now = cut_lineage(root)
    levels = [now]
    while True:  # as many rounds as the deepest document has levels
        inner = spark.sql("SELECT doc, path AS above, pattern AS above_pattern, e.pos, e.key AS inner_key, e.value FROM {now}, LATERAL variant_explode(value) AS e", now=now)
        dot = lambda c: F.when(F.col(c) == "", F.lit("")).otherwise(F.lit("."))
        listed = F.col("inner_key").isNull()
        path = F.when(listed, F.concat("above", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("above", dot("above"), "inner_key"))
        name = F.when(F.col("above_pattern").isin(*free), "*").otherwise(F.col("inner_key"))
        pattern = F.when(listed, F.concat("above_pattern", F.lit("[*]"))).otherwise(F.concat("above_pattern", dot("above_pattern"), name))
        now = cut_lineage(inner.select("doc", path.alias("path"), pattern.alias("pattern"), "above", "above_pattern", F.col("inner_key").alias("key"), "value"))
        if now.isEmpty():
            break
        levels.append(now)
    every = reduce(DataFrame.union, levels)
    kind = F.when(F.col("value").isNull(), "broken").otherwise(kind_of("value"))
    text = F.when(kind.isin("text", "whole", "number", "boolean"), F.try_variant_get("value", "$", "string"))
    return every.select("doc", "path", "pattern", "above", "above_pattern", "key", kind.alias("kind"), text.alias("text"))


@dataclass
class _Place:
    """A pattern that rules speak of, what they ask of its nodes, and the places right below it."""

    at: str | None
    asks: set[str] = field(default_factory=set)  # kind, text, there, members
    named: dict[str, _Place] = field(default_factory=dict)
    any: _Place | None = None
    items: _Place | None = None
    known: list[str] = field(default_factory=list)

    @property
    def mixed(self) -> bool:
        """No single type holds what rules ask of it."""
        views = bool(self.named) + bool(self.any) + bool(self.items)
        return views > 1 or (views == 1 and "text" in self.asks)

    def struct(self, numbered: bool = False) -> str:
        names = [f"_{i}" if numbered else f"`{k.replace('`', '``')}`" for i, k in enumerate(self.named)]
        return f"struct<{', '.join(f'{n}: {p.type(numbered)}' for n, p in zip(names, self.named.values(), strict=True))}>"

    def type(self, numbered: bool = False) -> str:
        """The type it is read as: where a document has another kind there, null, or JSON for a text. Members are
        numbered in the end, as their names may differ in case only."""
        if self.mixed:
            return "variant"
        if self.items:
            return f"array<{self.items.type(numbered)}>"
        return f"map<string, {self.any.type(numbered)}>" if self.any else self.struct(numbered) if self.named else "string"


def _above(at: str) -> str:
    """The pattern that holds this one."""
    return at[:-3] if at.endswith("[*]") else at.rpartition(".")[0]


def _places(rules: Rules) -> _Place:
    """The root of all places that rules speak of; deeper nodes and others cannot be at fault."""
    places = {"": _Place("")}

    def place(at: str) -> _Place:
        if at not in places:
            held, key = place(_above(at)), at.rpartition(".")[2]
            places[at] = _Place(at)
            if at.endswith("[*]"):
                held.items = places[at]
            elif held.at not in rules.free:
                held.named[key] = places[at]
            elif key == "*":  # members of a free mapping go by no other name
                held.any = places[at]
        return places[at]

    told = {"kind": [r[0] for r in (*rules.kinds, *rules.least)], "": [r[0] for r in (*rules.required, *rules.one_of, *rules.after, *rules.known)]}
    told["text"] = [r[0] for r in (*rules.shapes, *rules.least)] + rules.unique + [x for a, b, _ in rules.refers for x in (a, f"{a}[*]", b)]
    for what, patterns in told.items():
        for at in patterns:
            place(at).asks.add(what)
    for at, key in rules.known:
        places[at].known.append(key)
    asked = [(at, [key], "there") for at, key in rules.required] + [(at, keys.split(" "), "there") for at, keys in rules.one_of] + [(at, keys, "text") for at, *keys in rules.after]
    for at, keys, what in asked:
        for key in keys:  # no pattern need name them
            places[at].named.setdefault(key, _Place(None)).asks.add(what)
    return places[""]


#: Kinds of scalars by their schema; what is left is a number.
SCALARS = {"STRING": "text", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "whole"}
MEMBERS, ITEMS = "map<string, variant>", "array<variant>"


@dataclass
class _Value:
    """What a variant holds behind some keys."""

    base: Column
    keys: tuple[str, ...] = ()

    def get(self, kind: str, numbered: str | None = None) -> Column:
        found = F.try_variant_get(self.base, "$" + "".join(f"['{k}']" for k in self.keys), kind)
        return found.cast(numbered) if numbered else found

    def member(self, key: str) -> _Value:
        if re.fullmatch(r"[A-Za-z0-9_ -]+", key):  # a path can be read without a copy of what it leads through
            return _Value(self.base, (*self.keys, key))
        return _Value(F.try_element_at(self.get(MEMBERS), F.lit(key)))

    def kind(self) -> Column:
        scalar = F.create_map(*[F.lit(x) for kv in SCALARS.items() for x in kv])
        # an object or a list of no fields tells what a value is without a copy of what it holds
        return (
            F.when(self.get("struct<>").isNotNull(), "mapping").when(self.get("array<struct<>>").isNotNull(), "list")
            .when(self.get("variant").isNotNull(), F.coalesce(F.try_element_at(scalar, F.schema_of_variant(self.get("variant"))), F.lit("number")))
        )

    def text(self) -> Column:
        """Of scalars only."""
        return F.when(self.get("struct<>").isNull() & self.get("array<struct<>>").isNull(), self.get("string"))


@dataclass
class _Node:
    """A node as it was read, and its value for what its type leaves open, which is looked at only there."""

    place: _Place
    read: Column
    value: _Value

    def _as(self, kind: str, numbered: str) -> Column:
        return _Value(self.read).get(kind, numbered) if self.place.mixed else self.read

    def members(self) -> Column:
        return self._as(self.place.struct(), self.place.struct(True))

    def member(self, key: str) -> _Node:
        p, read = self.place.named[key], self.members()[f"_{list(self.place.named).index(key)}"]
        return _Node(p, read, _Value(read) if p.mixed else self.value.member(key))

    def each(self) -> tuple[Column, Column]:
        """Entries of a mapping as they are read, and their values."""
        p = self.place.any
        entries = F.map_entries(self._as(f"map<string, {p.type()}>", f"map<string, {p.type(True)}>"))
        return F.coalesce(entries, F.array().cast(f"array<struct<key: string, value: {p.type(True)}>>")), F.coalesce(F.map_values(self.value.get(MEMBERS)), F.array().cast(ITEMS))

    def listed(self) -> tuple[Column, Column]:
        """Items of a list as they are read, and their values."""
        p = self.place.items
        items = self._as(f"array<{p.type()}>", f"array<{p.type(True)}>")
        return F.coalesce(items, F.array().cast(f"array<{p.type(True)}>")), F.coalesce(self.value.get(ITEMS), F.array().cast(ITEMS))

    @property
    def plain(self) -> bool:
        return self.place.type() == "string"

    def kind(self) -> Column:
        """Null if it is not there, and for null where that spares a look."""
        if self.place.mixed:
            return self.value.kind()
        known = F.when(self.read.isNotNull(), self.value.kind() if self.plain else F.lit("list" if self.place.items else "mapping"))
        return known if self.plain else known.otherwise(self.value.kind())

    def text(self) -> Column:
        """Of scalars only: what is read from a mapping or a list begins with a bracket."""
        if not self.plain:
            return self.value.text()
        return F.when(self.read.startswith("[") | self.read.startswith("{"), self.value.text()).otherwise(self.read)

    def there(self) -> Column:
        if self.place.mixed:
            return self.read.isNotNull() & ~F.is_variant_null(self.read)
        return self.read.isNotNull() if self.plain else self.read.isNotNull() | (F.coalesce(self.value.kind(), F.lit("null")) != "null")


def _way(at: str) -> list[str]:
    return [*_way(_above(at)), at] if at else []


NO_TEXTS = "cast(array() as array<string>)"


def _texts(value: Column, root: _Place, at: str, keys: bool = False) -> Column:
    """Texts, or keys, of all nodes of a pattern."""

    def below(v: Column, place: _Place, way: list[str], key: Column | None = None) -> Column:
        if not way:
            return F.array(F.when(v.isNotNull(), key) if keys else _Value(v).text())
        if way[0].endswith("[*]"):
            return F.flatten(F.array_compact(F.transform(_Value(v).get(ITEMS), lambda x: below(x, place.items, way[1:]))))
        if place.any:
            return F.flatten(F.array_compact(F.transform(F.map_entries(_Value(v).get(MEMBERS)), lambda e: below(e["value"], place.any, way[1:], e["key"]))))
        last = way[0].rpartition(".")[2]
        return below(F.try_element_at(_Value(v).get(MEMBERS), F.lit(last)), place.named[last], way[1:], F.lit(last)) if last in place.named else F.expr(NO_TEXTS)

    return F.coalesce(F.array_compact(below(value, root, _way(at))), F.expr(NO_TEXTS))


def _texts_read(read: Column, root: _Place, at: str, keys: bool = False) -> Column | None:
    """The same of what has been read, with JSON of mappings and lists among texts; None where the types don't hold it."""
    place, lists, way = root, False, _way(at)
    for n, step in enumerate(way, 1):
        flat = F.flatten(F.array_compact(read)) if lists and step.endswith("[*]") and not place.mixed else read
        if place.mixed:
            if not (step.endswith("[*]") and lists and place.items.type() == "string"):
                return None
            read, place = F.flatten(F.array_compact(read.try_cast("array<array<string>>"))), place.items
        elif step.endswith("[*]"):
            read, place, lists = flat, place.items, True
        elif place.any:
            if lists:
                return None
            read, place, lists = F.map_keys(read) if keys and n == len(way) else F.map_values(read), place.any, True
        elif (last := step.rpartition(".")[2]) in place.named:
            read, place = read[f"_{list(place.named).index(last)}"], place.named[last]
            if keys and n == len(way):
                return None
        else:
            return F.expr(NO_TEXTS)
    if place.mixed and not keys:
        read = read.try_cast("array<string>") if lists else _Value(read).text()
    elif place.type() != "string" and not keys:
        return None
    return F.coalesce(F.array_compact(read if lists else F.array(read)), F.expr(NO_TEXTS))


def _size(text: Column) -> Column:
    """A number, or the minutes of HH:MM. Clocks come first: that a text is no number is slow to tell."""
    clock = F.substring_index(text, ":", 1).try_cast("double") * 60 + F.substring_index(text, ":", -1).try_cast("double")
    return F.when(F.rlike(text, F.lit(r"^(\d{1,2}):(\d{2})$")), clock).otherwise(text.try_cast("double"))


NO_FAULTS = "cast(array() as array<struct<path:string,what:string>>)"


def faults(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc, path and what: all faults of all documents. docs: doc, text (JSON; null or broken is a fault of its own).

    No rule looks beyond its document, so nothing is written or shuffled. Rules are as deep as their longest pattern, so
    the places they speak of are known beforehand and a document is read into them at once. Names that are listed twice
    or not known are found over the names alone. Then the outermost lists are laid side by side and dealt into rows, the
    first items of all of them in the first row, so that rules are compiled expressions over a row; only lists within
    lists are gone through as arrays. A place is where a document has it, whatever dots or brackets its keys hold.
    """
    top = _places(rules)
    fault = lambda path, what: F.struct(path.alias("path"), what.alias("what"))
    listed = lambda bad, node: (F.size(bad) > 0) & F.array_contains(bad, node.text())
    quote = lambda t: F.concat(F.lit("'"), F.coalesce(t, F.lit("null")), F.lit("'"))

    def own(node: _Node, path: Column, opened) -> tuple[list[Column], list[Column]]:
        """Faults, each null where there is none, and lists of such, of a node and those below it; `opened` takes lists
        and free mappings."""
        place = node.place
        child = lambda key: F.concat(path, F.when(path == "", "").otherwise("."), key)
        of = lambda rows: [r[1:] for r in rows if r[0] == place.at]
        lacks = lambda key: node.members().isNotNull() & ~node.member(key).there()
        said = lambda key: node.member(key).text()
        one, many = [], []
        for (key,) in of(rules.required):
            one.append(F.when(lacks(key), fault(child(F.lit(key)), F.lit("is required"))))
        for (kinds,) in of(rules.kinds):
            allowed = kinds.split(" ")
            one.append(F.when(~node.kind().isin("null", *allowed, *(["whole"] if "number" in allowed else [])), fault(path, F.lit(f"is no {' or '.join(allowed)}"))))
        for shape, word in of(rules.shapes):
            one.append(F.when(~F.rlike(node.text(), F.lit(shape)), fault(path, F.concat(quote(node.text()), F.lit(f" is no {word}")))))
        for (keys,) in of(rules.one_of):
            one.append(F.when(reduce(Column.__and__, map(lacks, keys.split(" "))), fault(path, F.lit(f"needs one of {', '.join(keys.split(' '))}"))))
        for key, later in of(rules.after):
            one.append(F.when(_size(said(later)) <= _size(said(key)), fault(child(F.lit(later)), F.concat(quote(said(later)), F.lit(" does not come after")))))
        for (least,) in of(rules.least):
            one.append(F.when(node.kind().isin("whole", "number") & (node.text().try_cast("double") < least), fault(path, F.concat(quote(node.text()), F.lit(" is too small")))))
        for i, at in enumerate(rules.unique):
            if at == place.at:
                one.append(F.when(listed(f"_t{i}", node), fault(path, F.concat(quote(node.text()), F.lit(" is listed more than once")))))
        for i, (at, _, word) in enumerate(rules.refers):
            if place.at in (at, f"{at}[*]"):
                one.append(F.when(listed(f"_x{i}", node), fault(path, F.concat(quote(node.text()), F.lit(f" is not a known {word}")))))
        if place.known:
            unknown = F.array_except(F.map_keys(node.value.get("map<string, struct<>>")), F.array(*[F.lit(k) for k in place.known]))
            many.append(F.when(F.size(unknown) > 0, F.transform(unknown, lambda k: fault(child(k), F.lit("is an unknown key")))))
        for key in place.named:
            inner = own(node.member(key), child(F.lit(key)), opened)
            one, many = one + inner[0], many + inner[1]
        if place.any:
            many += opened(place.any, *node.each(), lambda e, v, _: own(_Node(place.any, e["value"], _Value(v)), child(e["key"]), within))
        if place.items:
            many += opened(place.items, *node.listed(), lambda x, v, i: own(_Node(place.items, x, _Value(v)), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), within))
        return one, many

    def within(place: _Place, read: Column, values: Column, of) -> list[Column]:
        """The faults of a list within a list, as one list; none if no rule holds for them."""
        flat, some = [], []

        def inner(x: Column, v: Column, i: Column) -> Column:
            one, many = of(x, v, i)
            flat.append(len(one) == 1 and not many)
            some.append(bool(one or many))
            return one[0] if flat[0] else every(one, many)

        both = F.struct(read.alias("read"), values.alias("values"))
        found = F.transform(F.array(both), lambda b: F.transform(b["values"], lambda v, i: inner(F.get(b["read"], i), v, i)))[0]
        looked = F.size(values) > 0  # this is compiled, the items are not
        if flat[0] and place.asks == {"text"} and (bad := [f"_x{i}" for i, (at, *_) in enumerate(rules.refers) if place.at in (at, f"{at}[*]")]):
            looked = reduce(Column.__or__, [F.size(c) > 0 for c in bad]) & looked
        return [F.when(looked, found if flat[0] else F.flatten(found))] if some[0] else []

    def every(one: list[Column], many: list[Column]) -> Column:
        none = F.expr(NO_FAULTS)
        return F.concat(F.array(*one) if one else none, *[F.coalesce(m, none) for m in many])

    rows = docs.select("doc", F.try_parse_json("text").alias("_value"))
    rows = rows.select("doc", "_value", _Value(F.col("_value")).get(top.type(), top.type(True)).alias("_read"))
    value, read, names = F.col("_value"), F.col("_read"), {}

    def texts(at: str, exact: bool = True, keys: bool = False) -> Column:
        quick = _texts_read(read, top, at, keys)
        if quick is None:
            return _texts(value, top, at, keys)
        joined = F.array_join(quick, "")
        return F.when(joined.contains("[") | joined.contains("{"), _texts(value, top, at)).otherwise(quick) if exact and not keys else quick

    for i, at in enumerate(rules.unique):
        names[f"_u{i}"] = F.sort_array(texts(at))
    for i, (at, to, _) in enumerate(rules.refers):
        # JSON among the uses does no harm: a text like it is as little known
        uses = F.concat(texts(at, False), texts(f"{at}[*]", False))
        names[f"_x{i}"] = F.when(F.size(uses) > 0, F.array_except(uses, texts(to, keys=to.endswith(".*"))))
    rows = rows.withColumns(names)
    rows = rows.withColumns({f"_t{i}": F.array_distinct(F.filter(f"_u{i}", lambda t, k: t == F.get(f"_u{i}", k + 1))) for i in range(len(rules.unique))})  # noqa: B023
    held = ["doc", *[c for c in rows.columns if c[:2] in ("_t", "_x")], "_own"]
    lists, dealt = {}, []

    def deal(_: _Place, read: Column, values: Column, of) -> list[Column]:
        lists.update({f"_r{len(dealt)}": read, f"_v{len(dealt)}": values})
        dealt.append(of)
        return []

    own_faults = every(*own(_Node(top, read, _Value(value)), F.lit(""), deal))
    broken = ["is no JSON"] + [f"is no {kinds.replace(' ', ' or ')}" for at, kinds in rules.kinds if at == ""]
    own_faults = F.when(value.isNull(), F.array(*[fault(F.lit(""), F.lit(what)) for what in broken])).otherwise(own_faults)
    rows = rows.select(*held[:-1], own_faults.alias("_own"), *[c.alias(k) for k, c in lists.items()])
    rows = rows.select(*held, F.arrays_zip(*lists).alias("_z") if lists else F.array().alias("_z"))
    rows = rows.select(*held, F.posexplode_outer("_z").alias("_i", "_z"))
    one, many = [], [F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_own"))]
    for k, of in enumerate(dealt):
        inner = of(F.col("_z")[f"_r{k}"], F.col("_z")[f"_v{k}"], F.col("_i"))
        one, many = one + inner[0], many + inner[1]
    found = rows.select("doc", every(one, many).alias("_f")).select("doc", F.explode_outer("_f").alias("f"))  # outer: else Spark tells all faults twice, to leave out empty lists
    return found.where(F.col("f").isNotNull()).select("doc", "f.*")


CLOCK, DATE = r"^([01]?\d|2[0-3]):[0-5]\d$", r"^\d{4}-\d{2}-\d{2}$"
# Fixed: what a schedule may and must hold.
SCHEDULE = Rules(
    required=[("", "project"), ("", "days"), ("cameras[*]", "name"), ("people[*]", "id"), ("deliverable_types[*]", "id"), ("deliverable_types[*]", "count"), ("sessions[*]", "id"), ("sessions[*]", "day"), ("sessions[*]", "start")],
    known=[("", k) for k in "project client timezone days cameras people registers sessions deliverable_types notes".split()]
    + [("cameras[*]", k) for k in "name prefix path_contains operator clock clock_offset_s stamp notes".split()]
    + [("people[*]", k) for k in "id name role notes".split()]
    + [("deliverable_types[*]", k) for k in "id title count duration_s template scope includes notes".split()]
    + [("sessions[*]", k) for k in "id day start end title capture registers feeds people cameras notes".split()]
    + [("sessions[*].capture[*]", k) for k in "operator text feeds registers".split()],
    kinds=[("days", "mapping"), ("cameras[*]", "mapping"), ("people[*]", "mapping"), ("deliverable_types[*]", "mapping"), ("sessions[*]", "mapping"), ("cameras[*].clock_offset_s", "number"), ("deliverable_types[*].count", "whole"), ("deliverable_types[*].duration_s", "list"), ("deliverable_types[*].duration_s[*]", "number")],
    shapes=[("days.*", DATE, "date (YYYY-MM-DD)"), ("sessions[*].start", CLOCK, "time (HH:MM)"), ("sessions[*].end", CLOCK, "time (HH:MM)"), ("cameras[*].stamp", "^(start|end)$", "start or end"),
            ("cameras[*].clock", "^(creation_time_utc|creation_time_local|timecode)$", "clock rule"), ("timezone", r"^[A-Za-z_]+(/[A-Za-z_+\-0-9]+)*$", "zone name")],
    unique=["cameras[*].name", "people[*].id", "deliverable_types[*].id", "sessions[*].id"],
    refers=[("sessions[*].day", "days.*", "day"), ("sessions[*].cameras", "cameras[*].name", "camera name"), ("sessions[*].registers", "registers[*]", "register"), ("sessions[*].feeds", "deliverable_types[*].id", "deliverable type"),
            ("sessions[*].people", "people[*].id", "person id"), ("sessions[*].capture[*].operator", "cameras[*].operator", "operator of a camera"), ("sessions[*].capture[*].feeds", "deliverable_types[*].id", "deliverable type"), ("sessions[*].capture[*].registers", "registers[*]", "register")],
    one_of=[("cameras[*]", "prefix path_contains")],
    after=[("sessions[*]", "start", "end")],
    least=[("deliverable_types[*].count", 0.0)],
    free=("days",),
)
