"""Rule conditions as data.

A condition is comparisons joined by and / or / not / parentheses. It is read once per rule into a program in
postfix order (a list of steps). Equality with a type, with a year and a searched keyword among the top conjuncts are
taken out as keys for joins; the program keeps the rest, which becomes a list of tests that jump forward: a test is an
interval of a number, a text or a keyword, and names the test to go on with. One small Spark expression follows the
jumps, so the number of different conditions is not limited by the size of a plan and only the tests that matter run.

A condition that is well-formed but calls a method, or names an unknown field, cannot be evaluated: it is readable
and never matches.
"""

import math
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_KINDS = {
    "entry_id": "text", "year": "number", "description": "text", "old_type": "text",
    "amount": "number", "date": "date", "quarter": "number", "notes": "text",
}
KEYWORD = r'(?i)"([^"]+)"\s+in\s+description'
# Words of the condition language.
WORDS = ("and", "or", "not", "in", "is", "true", "false", "none", "null")

_TOKEN = re.compile(
    r"""\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<number>-?[0-9]+(?:\.[0-9]+)?)(?![A-Za-z0-9_.])|(?P<name>[^\W\d]\w*)|(?P<sign>==|!=|>=|<=|[<>().,]))""", re.ASCII)
#: Where an entry keeps a field: texts and numbers are two arrays, dates count as days among the numbers.
TEXTS = ("entry_id", "description", "old_type", "notes")
NUMBERS = ("year", "amount", "quarter", "date")
#: Where a test jumps to when the condition is decided. Other jumps name a later test.
HOLDS, FAILS = 1 << 30, -1
TEST = "struct<at:int,kind:string,left:int,right:int,low:double,high:double,text:string,op:string,negated:boolean,yes:int,no:int>"
READ = f"struct<readable:boolean,unknown:array<string>,types:array<string>,match_year:int,match_keyword:string,tests:array<{TEST}>>"
WAY = f"struct<place:int,low:double,high:double,lows:array<double>,highs:array<double>,same:array<string>,other:array<string>,tests:array<{TEST}>>"
#: A condition that can hold in more ways is kept whole.
MAX_WAYS = 16


class _Unreadable(Exception):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise _Unreadable
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Reader:
    """Recursive descent over the tokens: or, and, not, comparison."""

    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, value: str) -> bool:
        if self.peek()[0] in ("name", "sign") and self.peek()[1] == value:
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise _Unreadable

    def whole(self):
        tree = self.joined("or", lambda: self.joined("and", self.negated))
        if self.peek()[0] != "end":
            raise _Unreadable
        return tree

    def joined(self, word: str, part):
        tree = part()
        while self.take(word):
            tree = (word, tree, part())
        return tree

    def negated(self):
        if self.take("not"):
            return ("not", self.negated())
        if self.peek() == ("sign", "("):
            self.at += 1
            tree = self.joined("or", lambda: self.joined("and", self.negated))
            self.expect(")")
            return tree
        left = self.operand()
        sign = self.peek()[1]
        if self.peek()[0] == "sign" and sign in ("==", "!=", ">=", "<=", ">", "<") or self.peek() == ("name", "in"):
            self.at += 1
            return ("compare", sign, left, self.operand())
        if left[0] == "call":  # a call may stand alone
            return ("error",)
        raise _Unreadable

    def operand(self) -> tuple[str, object]:
        kind, value = self.peek()
        self.at += 1
        if kind == "text":
            return "text", value[1:-1]
        if kind == "number":
            return "number", float(value)
        if kind != "name" or value in ("and", "or", "not", "in", "is"):
            raise _Unreadable
        if value in ("null", "none", "None"):
            return "null", None
        if value in ("true", "false", "True", "False"):
            return "bool", value.lower() == "true"
        result: tuple[str, object] = ("field", value)
        while self.take("."):
            if self.peek()[0] != "name":
                raise _Unreadable
            self.at += 1
            result = ("dotted", value)
        if self.take("("):
            while not self.take(")"):
                self.operand()
                if self.peek() != ("sign", ")"):
                    self.expect(",")
            result = ("call", value)
        return result


def _step(sign: str, left, right) -> dict:
    """A comparison as a step. What the kinds decide already becomes true, false or error."""
    def side(operand):
        kind, value = operand
        return {"field": value if kind == "field" else None, "text": value if kind == "text" else None, "number": value if kind == "number" else None}

    kinds = [FIELD_KINDS.get(value) if kind == "field" else kind for kind, value in (left, right)]
    fixed = lambda op: {"op": op, "kind": None, "left": None, "right": None}
    if None in kinds or "dotted" in kinds or "call" in kinds:
        return fixed("error")
    equality = sign in ("==", "!=")
    if "null" in kinds:
        if not equality:
            return fixed("error")
        if kinds == ["null", "null"]:
            return fixed("true" if sign == "==" else "false")
        other = right if kinds[0] == "null" else left
        if other[0] != "field":
            return fixed("false" if sign == "==" else "true")
        return {"op": sign, "kind": "null", "left": side(other), "right": None}
    if set(kinds) == {"date", "text"}:
        kinds = ["date", "date"]
    if kinds[0] != kinds[1]:
        return fixed({"==": "false", "!=": "true"}.get(sign, "error"))
    if kinds[0] == "bool":
        return fixed("error" if not equality else "true" if (left[1] == right[1]) == (sign == "==") else "false")
    if sign == "in" and kinds[0] != "text":
        return fixed("error")
    return {"op": sign, "kind": kinds[0], "left": side(left), "right": side(right)}


def _program(tree) -> list[dict]:
    if tree[0] == "compare":
        return [_step(*tree[1:])]
    if tree[0] == "error":
        return [{"op": "error", "kind": None, "left": None, "right": None}]
    steps = [s for part in tree[1:] for s in _program(part)]
    return [*steps, {"op": tree[0], "kind": None, "left": None, "right": None}]


def _conjuncts(tree) -> list:
    return _conjuncts(tree[1]) + _conjuncts(tree[2]) if tree[0] == "and" else [tree]


def read_condition(text: str | None) -> dict:
    """What is known of a condition: the fields of READ and, uncompiled, its program.

    `types` are the types one of which an entry must have; a single one among the top conjuncts is `match_type` too
    and left out of the program.
    """
    text = text or ""
    names = [m.group("name") for m in _TOKEN.finditer(re.sub(r"\.\s*[^\W\d]\w*", "", re.sub(r"\"[^\"]*\"|'[^']*'", " ", text))) if m.group("name")]
    unknown = [n for n in dict.fromkeys(names) if n.lower() not in WORDS and n not in FIELD_KINDS]
    out = {"readable": True, "unknown": unknown, "types": None, "match_type": None, "match_year": None, "match_keyword": None, "program": None}
    try:
        tree = _Reader(text).whole()
        out["types"] = _types(tree)
    except _Unreadable:
        return out | {"readable": False, "program": [{"op": "error", "kind": None, "left": None, "right": None}]}
    rest = []
    for part in _conjuncts(tree):
        if part[0] == "compare":
            sign, left, right = part[1:]
            if sign == "==" and left[0] != "field":
                left, right = right, left
            if sign == "==" and left == ("field", "old_type") and right[0] == "text" and out["match_type"] is None:
                out["match_type"], out["types"] = right[1], [right[1]]
                continue
            if sign == "==" and left == ("field", "year") and right[0] == "number" and right[1] == int(right[1]) and abs(right[1]) < 1e9 and out["match_year"] is None:
                out["match_year"] = int(right[1])
                continue
            if sign == "in" and left[0] == "text" and right == ("field", "description") and out["match_keyword"] is None:
                out["match_keyword"] = left[1]
                continue
        rest.append(part)
    if rest:
        program = _program(rest[0])
        for part in rest[1:]:
            program += [*_program(part), {"op": "and", "kind": None, "left": None, "right": None}]
        out["program"] = program
    return out


# --- conditions as tests that jump ------------------------------------------------------------

def _place(name: str) -> int:
    return (NUMBERS if FIELD_KINDS[name] != "text" else TEXTS).index(name)


def _test(kind: str, **more) -> dict:
    return {"kind": kind, "left": None, "right": None, "low": None, "high": None, "text": None, "op": None, "negated": False} | more


_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "in": lambda a, b: a in b}
_MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _range(op: str, value: float) -> tuple[float, float]:
    """The least and the greatest number for which the comparison holds; nothing is above NaN."""
    return {"==": (value, value), ">=": (value, math.nan), "<=": (-math.inf, value),
            ">": (math.nextafter(value, math.inf), math.nan), "<": (-math.inf, math.nextafter(value, -math.inf))}[op]


def _as_test(step: dict) -> tuple[dict, list[dict]]:
    """A step of a program as a test, and the tests that must hold for it to be decidable."""
    op, kind, left, right = step["op"], step["kind"], step["left"], step["right"]
    if op in ("true", "false"):
        return _test("true", negated=op == "false"), []
    if kind == "null":
        return _missing(left["field"]) | {"negated": op == "!="}, []
    negated, op = op == "!=", "==" if op == "!=" else op
    fields = [s["field"] for s in (left, right)]
    needed = [] if op == "==" else [_missing(f) | {"negated": True} for f in fields if f]
    if kind != "date" and None in fields:
        if fields == [None, None]:
            name = "text" if kind == "text" else "number"
            return _test("true", negated=_ORDER[op](left[name], right[name]) == negated), needed
        if kind == "number":
            field, value = (fields[0], right["number"]) if fields[0] else (fields[1], left["number"])
            low, high = _range(op if fields[0] else _MIRRORED.get(op, op), value)
            return _test("range", left=_place(field), low=low, high=high, negated=negated), needed
        field, value = (fields[0], right["text"]) if fields[0] else (fields[1], left["text"])
        if op == "==" or op == "in" and fields[1]:
            return _test("same" if op == "==" else "has", left=_place(field), text=value, negated=negated), needed
    text = left["text"] if not fields[0] else right["text"]
    if kind == "date":
        # A day is that of the date (-1) or of a text: a field, or the literal.
        sides = [None if f is None else -1 if FIELD_KINDS[f] == "date" else _place(f) for f in fields]
        if op != "==":
            needed += [_test("day", left=side, text=text) for side in sides if side != -1]
        return _test("days", left=sides[0], right=sides[1], text=text, op=op, negated=negated), needed
    places = [None if f is None else _place(f) for f in fields]
    return _test("texts" if kind == "text" else "numbers", left=places[0], right=places[1], text=text, op=op, negated=negated), needed


def _missing(field: str) -> dict:
    return _test("no text" if FIELD_KINDS[field] == "text" else "no number", left=_place(field))


def compile_program(program: list[dict] | None) -> list[dict] | None:
    """The program as tests in order, each naming the test to go on with when it holds and when it fails.

    All jumps lead forward, so one pass decides, and whatever the result no longer depends on is skipped. What must be
    known for the condition to be decidable is tested first.
    """
    if program is None:
        return None
    if any(s["op"] == "error" for s in program):
        return [_test("true", at=0, yes=FAILS, no=FAILS)]
    needed, stack = {}, []  # a tree node: (number of tests, operator, parts) or (1, None, test)
    for step in program:
        if step["op"] in ("and", "or"):
            right, left = stack.pop(), stack.pop()
            stack.append((left[0] + right[0], step["op"], (left, right)))
        elif step["op"] == "not":
            part = stack.pop()
            stack.append((part[0], "not", (part,)))
        else:
            test, before = _as_test(step)
            needed.update({tuple(t.items()): t for t in before})
            stack.append((1, None, test))
    out = [t | {"at": i, "yes": i + 1, "no": FAILS} for i, t in enumerate(needed.values())]
    todo = [(stack.pop(), HOLDS, FAILS)]
    while todo:
        (size, op, parts), yes, no = todo.pop()
        if op is None:
            out.append(parts | {"at": len(out), "yes": yes, "no": no})
        elif op == "not":
            todo.append((parts[0], no, yes))
        else:  # the left part comes first; undecided, it goes on with the first test of the right one
            after = len(out) + parts[0][0]
            todo += [(parts[1], yes, no), (parts[0], after if op == "and" else yes, after if op == "or" else no)]
    return out


def ways(tests: list[dict] | None) -> list[dict]:
    """The ways in which a condition can hold: at least one does if it holds, never two for one entry.

    A way is a path through the tests to HOLDS, that is a conjunction: an interval of one number (`place` among the
    numbers, `low`, `high`; null where none is needed) by which it is found, intervals of other numbers, a text that each
    text field must be (`same`) or must not be (`other`), and whatever else its path asks, as tests.
    """
    if tests is None:
        return [_way(())]
    found, todo = [], [(0, ())]
    while todo:
        at, path = todo.pop()
        if at == FAILS:
            continue
        if at == HOLDS:
            found.append(path)
        elif tests[at]["kind"] == "true":
            todo.append((tests[at]["no" if tests[at]["negated"] else "yes"], path))
        else:
            todo += [(tests[at]["no"], (*path, (tests[at], False))), (tests[at]["yes"], (*path, (tests[at], True)))]
        if len(found) + len(todo) > MAX_WAYS:
            return [_way(()) | {"tests": tests}]
    return [_way(path) for path in found]


def _way(path: tuple) -> dict:
    inside: dict = {}
    top = lambda x: (math.isnan(x), x)  # noqa: E731  # nothing is above NaN

    def narrow(place: int, low: float, high: float) -> None:
        was = inside.get(place, (-math.inf, math.nan))
        inside[place] = max(was[0], low), min(was[1], high, key=top)

    rest, same, other = [], [None] * len(TEXTS), [None] * len(TEXTS)
    for t, yes in path:
        if t["kind"] == "range" and yes != t["negated"]:
            narrow(t["left"], t["low"], t["high"])
        elif t["kind"] == "no number" and yes == t["negated"]:
            narrow(t["left"], -math.inf, math.nan)
    for t, yes in path:
        holds, place = yes != t["negated"], t["left"]
        if t["kind"] == "range" and holds or t["kind"] == "no number" and not holds:
            continue
        if t["kind"] == "range" and place in inside and (t["low"] == -math.inf) != math.isnan(t["high"]):
            narrow(place, *((math.nextafter(t["high"], math.inf), math.nan) if t["low"] == -math.inf else (-math.inf, math.nextafter(t["low"], -math.inf))))
        elif t["kind"] == "same" and (same if holds else other)[place] in (None, t["text"]):
            (same if holds else other)[place] = t["text"]
        else:
            rest.append((t, yes))
    width = lambda place: top(inside[place][1] - inside[place][0])
    place = min(inside, key=width, default=None)
    low, high = inside.pop(place, (None, None))
    on = [*range(1, len(rest)), HOLDS]
    return {
        "place": place, "low": low, "high": high, "same": same if any(x is not None for x in same) else None,
        "lows": [inside.get(i, (None, None))[0] for i in range(len(NUMBERS))] if inside else None,
        "highs": [inside.get(i, (None, None))[1] for i in range(len(NUMBERS))] if inside else None,
        "other": other if any(x is not None for x in other) else None,
        "tests": [t | {"at": i, "yes": on[i] if yes else FAILS, "no": FAILS if yes else on[i]} for i, (t, yes) in enumerate(rest)] or None}


def _types(tree) -> list[str] | None:
    """The types of which an entry must have one for the condition to hold; None where any may do."""
    if tree[0] == "compare":
        for a, b in ((tree[2], tree[3]), (tree[3], tree[2])):
            if tree[1] == "==" and a == ("field", "old_type") and b[0] == "text":
                return [b[1]]
        return None
    if tree[0] in ("and", "or"):
        found = [_types(part) for part in tree[1:]]
        if tree[0] == "and":
            return min((f for f in found if f is not None), key=len, default=None)
        return None if None in found else list(dict.fromkeys(found[0] + found[1]))
    return None


_TEST_TYPE = pa.struct([
    ("at", pa.int32()), ("kind", pa.string()), ("left", pa.int32()), ("right", pa.int32()), ("low", pa.float64()), ("high", pa.float64()),
    ("text", pa.string()), ("op", pa.string()), ("negated", pa.bool_()), ("yes", pa.int32()), ("no", pa.int32())])
_READ_TYPE = pa.struct([
    ("readable", pa.bool_()), ("unknown", pa.list_(pa.string())), ("types", pa.list_(pa.string())), ("match_year", pa.int32()), ("match_keyword", pa.string()),
    ("tests", pa.list_(_TEST_TYPE))])


_WAYS_TYPE = pa.list_(pa.struct([
    ("place", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64())),
    ("same", pa.list_(pa.string())), ("other", pa.list_(pa.string())), ("tests", pa.list_(_TEST_TYPE))]))


def _each(texts: pa.Array, kind: pa.DataType, known) -> pa.Array:
    """What is known of each text; equal texts of a batch are looked at once."""
    seen = texts.dictionary_encode()
    if seen.null_count:
        seen = texts.dictionary_encode(null_encoding="encode")
    found = pa.array([known(t) for t in seen.dictionary.to_pylist()], kind)
    return found if len(found) == len(texts) else found.take(seen.indices)


def _reading(text: str | None) -> dict:
    known = read_condition(text)
    return {f.name: known.get(f.name) for f in _READ_TYPE} | {"tests": compile_program(known["program"])}


def read(condition: Column) -> Column:
    """READ of each condition of a rule table."""
    @F.arrow_udf(READ)
    def reading(texts: pa.Array) -> pa.Array:
        return _each(texts, _READ_TYPE, _reading)

    return reading(condition)


def read_ways(condition: Column) -> Column:
    """READ of each condition and the ways in which it can hold; `tests` only of those that any type may meet."""
    kind = pa.struct([*_READ_TYPE, ("ways", _WAYS_TYPE)])

    def known(text: str | None) -> dict:
        row = _reading(text)
        return row | {"ways": ways(row["tests"]) if row["types"] else None, "tests": None if row["types"] else row["tests"]}

    @F.arrow_udf(f"{READ[:-1]},ways:array<{WAY}>>")
    def reading(texts: pa.Array) -> pa.Array:
        return _each(texts, kind, known)

    return reading(condition)


def well_formed(condition: Column) -> Column:
    """Whether a column of conditions can be read."""
    return read(condition)["readable"]


def unknown_fields(condition: Column) -> Column:
    """Distinct names in a condition that are not journal fields, in order of appearance."""
    return read(condition)["unknown"]


# --- deciding a condition for an entry --------------------------------------------------------

def entry_fields(columns: list[str], prefix: str = "") -> Column:
    """The fields of a journal row that conditions may name, as texts and numbers; one that the row lacks is null."""
    def field(name: str, kind: str) -> Column:
        return (F.col(f"{prefix}{name}") if name in columns else F.lit(None)).cast(kind)

    numbers = [F.unix_date(field(f, "date")).cast("double") if f == "date" else field(f, "double") for f in NUMBERS]
    return F.struct(F.array(*[field(f, "string") for f in TEXTS]).alias("texts"), F.array(*numbers).alias("numbers"))


def _compared(op: Column, left: Column, right: Column) -> Column:
    return (F.when(op == "==", left.eqNullSafe(right)).when(op == "<", left < right).when(op == "<=", left <= right)
            .when(op == ">", left > right).when(op == ">=", left >= right))


def _decided(test: Column, entry: Column) -> Column:
    """Whether a test holds for an entry. The usual kinds come first."""
    text = lambda place: F.get(entry["texts"], place)
    number = lambda place: F.get(entry["numbers"], place)
    own = lambda place: F.when(place.isNull(), test["text"]).otherwise(text(place))
    day = lambda place: F.when(place == -1, number(F.lit(NUMBERS.index("date")))).otherwise(
        F.unix_date(own(place).try_cast("date")).cast("double"))
    kind, op, left, right = test["kind"], test["op"], test["left"], test["right"]
    holds = (
        F.when(kind == "range", (number(left) >= test["low"]) & (number(left) <= test["high"]))
        .when(kind == "same", text(left) == test["text"]).when(kind == "has", F.contains(text(left), test["text"]))
        .when(kind == "no number", number(left).isNull()).when(kind == "no text", text(left).isNull()).when(kind == "true", F.lit(True))
        .when(kind == "texts", F.when(op == "in", F.contains(own(right), own(left))).otherwise(_compared(op, own(left), own(right))))
        .when(kind == "numbers", _compared(op, number(left), number(right)))
        .when(kind == "days", _compared(op, day(left), day(right))).when(kind == "day", day(left).isNotNull()))
    return F.coalesce(holds, F.lit(False)) != test["negated"]


def holds(tests: Column, entry: Column) -> Column:
    """Whether a condition holds for an entry; one without tests does, one that cannot be evaluated does not.

    Comparing a missing value by order, or calling a method, is an error, and an error anywhere means that the rule does
    not match, whatever the rest says.
    """
    def run(at: Column, test: Column) -> Column:
        return F.when(at != test["at"], at).when(_decided(test, entry), test["yes"]).otherwise(test["no"])

    return F.when(tests.isNull(), F.lit(True)).otherwise(F.aggregate(tests, F.lit(0), run) == HOLDS)


def way_parts(way: Column) -> dict[str, Column]:
    """What a way asks of each field beside the interval by which it is found, a column each, null where it asks nothing."""
    sides = (("low", "lows", NUMBERS), ("high", "highs", NUMBERS), ("same", "same", TEXTS), ("other", "other", TEXTS))
    return {f"{side}_{name}": F.get(way[field], F.lit(i)) for side, field, names in sides for i, name in enumerate(names)}


def entry_parts(entry: Column) -> dict[str, Column]:
    """The fields of an entry, a column each."""
    return {f"entry_{name}": F.get(entry[kind], F.lit(i)) for kind, names in (("numbers", NUMBERS), ("texts", TEXTS)) for i, name in enumerate(names)}


def way_holds(asked: set[str]) -> list[Column]:
    """Whether a way, of which the interval by which it is found is met, holds but for its `tests`, from the columns of
    `way_parts` and `entry_parts`; only those are looked at that some way asks for."""
    own = lambda name: F.col(f"entry_{name}")
    parts = [F.col(f"low_{n}").isNull() | ((own(n) >= F.col(f"low_{n}")) & (own(n) <= F.col(f"high_{n}"))) for n in NUMBERS if f"low_{n}" in asked]
    parts += [F.col(f"same_{n}").isNull() | (own(n) == F.col(f"same_{n}")) for n in TEXTS if f"same_{n}" in asked]
    return parts + [F.col(f"other_{n}").isNull() | ~own(n).eqNullSafe(F.col(f"other_{n}")) for n in TEXTS if f"other_{n}" in asked]


def condition_column(text: str) -> Column:
    """Boolean column that is false where the condition is false or cannot be evaluated."""
    if not read_condition(text)["readable"]:
        raise ValueError(f"Invalid rule condition: {text}")
    tests = compile_program(_program(_Reader(text).whole()))
    return holds(F.array(*[F.struct(*[F.lit(t[f.name]).cast(_SPARK[f.type]).alias(f.name) for f in _TEST_TYPE]) for t in tests]), entry_fields(list(FIELD_KINDS)))


_SPARK = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}
