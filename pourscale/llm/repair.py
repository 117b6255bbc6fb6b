"""Conversation structure repair by dynamic programming over a grammar.

The role initials of a conversation should read ``(s?(ua)+)?``: maybe a system row, then user and assistant in
turns. Rows may be kept (free), have their role set to user or assistant (``RETAG``), be deleted (``DELETE``; blank
rows and repetitions must be) or get rows without text inserted before or after them (``INSERT``); a row whose text
stops in mid-sentence costs ``TRUNCATED`` more unless deleted. The cheapest edits win, of equally cheap ones the
least string of their initials D, I, K, R.

Each row becomes one of nine symbols (initial and fault), each conversation a string of them, cut every ``CHUNK``
rows. Re-Pair rounds replace frequent pairs of neighbouring symbols by rules; the counts of pairs cover all strings.
A round takes pairs by falling count where none can overlap another one (a symbol is the left half of pairs or
the right half, not both), so replacing them at once equals replacing them one by one. A symbol's meaning is a matrix: for each
pair of states of the pattern the least cost and the audit, a rope of its parts. Rules are evaluated bottom-up, each
once, whatever the number of conversations they occur in; a string's matrix is the product of those of the symbols
left in it. Distinct strings are evaluated once. At most ``RULES`` rules are made, pairs beyond them stay as they
are: that changes the time, not the result.

A conversation's rows are ordered by turn (nulls first), then by role and MD5 of the text, so equal rows lie together.
Null roles and texts are one space. Null conversation ids are one conversation. Rows equal in all columns are rows of
their own (the later ones repetitions). An empty table gives no rows. The order of the rows of a conversation spreads
over tasks; its audit, one character a row, and its repaired rows go through one task as a stream.
"""

from __future__ import annotations

import hashlib
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pourscale.llm.common import written
from pourscale.llm.ordered import join_by, numbered

RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
CHUNK = 1024
RULES = 4096
ROUNDS = 32
#: A pair must occur this often to become a rule.
LEAST = 2
_FIRST_RULE = 0xE000  # rules are characters of the private use area
#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_BASE, _MODULUS = 911_382_323, (1 << 61) - 1


class Rope:
    """A string of edits made of its parts, with a hash so that two can be compared without spelling them out."""

    __slots__ = ("text", "left", "right", "size", "code")

    def __init__(self, text=None, left=None, right=None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.size = left.size + right.size
            self.code = (left.code * _power(right.size) + right.code) % _MODULUS
        else:
            self.size, self.code = len(text), _code(text)

    def prefix(self, n: int) -> int:
        """Hash of the first n characters."""
        at, code = self, 0
        while n:
            if at.text is not None:
                return (code * _power(n) + _code(at.text[:n])) % _MODULUS
            if n <= at.left.size:
                at = at.left
            else:
                code, n, at = (code * _power(at.left.size) + at.left.code) % _MODULUS, n - at.left.size, at.right
        return code

    def char(self, n: int) -> str:
        at = self
        while at.text is None:
            if n < at.left.size:
                at = at.left
            else:
                n, at = n - at.left.size, at.right
        return at.text[n]

    def __lt__(self, other: Rope) -> bool:
        if self.size == other.size and self.code == other.code:
            return False
        low, high = 0, min(self.size, other.size)  # the longest common prefix lies between
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.prefix(middle) == other.prefix(middle) else (low, middle - 1)
        if low == min(self.size, other.size):
            return self.size < other.size
        return self.char(low) < other.char(low)

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            at = stack.pop()
            if at.text is not None:
                out.append(at.text)
            else:
                stack += (at.right, at.left)
        return "".join(out)


@cache
def _power(n: int) -> int:
    return pow(_BASE, n, _MODULUS)


def _code(text: str) -> int:
    return reduce(lambda code, c: (code * _BASE + ord(c)) % _MODULUS, text, 0)


def joined(a: Rope, b: Rope) -> Rope:
    if not a.size or not b.size:
        return a if a.size else b
    if a.size + b.size <= 8 and a.text is not None and b.text is not None:
        return Rope(a.text + b.text)
    return Rope(left=a, right=b)


#: How many inserts lead from a state to another one.
_INSERTS = {START: {START: 0, USER: 1, ASSISTANT: 2}, SYSTEM: {SYSTEM: 0, USER: 1, ASSISTANT: 2}, USER: {USER: 0, ASSISTANT: 1}, ASSISTANT: {ASSISTANT: 0, USER: 1}}
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}


def better(a, b):
    """The cheaper of two (cost, rope), of equal costs the lesser rope; None is no way at all."""
    if a is None or b is None:
        return a or b
    return a if a[0] < b[0] or (a[0] == b[0] and not b[1] < a[1]) else b


def row_matrix(symbol: str) -> list:
    """The matrix of one row: 16 entries, from state i to state j at 4 * i + j. Rows to be inserted go before it."""
    kind, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    made = [None] * 16
    for i, ways in _INSERTS.items():
        for k, inserts in ways.items():
            ops = [(DELETE, "D", k)]
            if kind != "x":
                ops += [(extra, "K", j) for j in [_NEXT[kind].get(k)] if j is not None]
                ops += [(RETAG + extra, "R", j) for role in "ua" for j in [_NEXT[role].get(k)] if j is not None]
            for cost, op, j in ops:
                made[4 * i + j] = better(made[4 * i + j], (INSERT * inserts + cost, Rope("I" * inserts + op)))
    return made


def product(a: list, b: list) -> list:
    """The matrix of one string after another one."""
    made = [None] * 16
    for i in range(4):
        for j in range(4):
            ways = [(a[4 * i + k], b[4 * k + j]) for k in range(4) if a[4 * i + k] and b[4 * k + j]]
            if ways:
                least = min(x[0] + y[0] for x, y in ways)
                found = [joined(x[1], y[1]) for x, y in ways if x[0] + y[0] == least]
                made[4 * i + j] = (least, found[0] if len(found) == 1 else min(found))
    return made


#: After the last row: inserts up to an end of the pattern.
_END = [None] * 16
for _i, _j, _n in ((START, START, 0), (SYSTEM, ASSISTANT, 2), (USER, ASSISTANT, 1), (ASSISTANT, ASSISTANT, 0)):
    _END[4 * _i + _j] = (INSERT * _n, Rope("I" * _n))


def matrices(rules: list[str]) -> dict[str, list]:
    """The matrix of every symbol and rule; rules are pairs of symbols or earlier rules."""
    made = {s: row_matrix(s) for s in "xsuaoSUAO"}
    for n, pair in enumerate(rules):
        made[chr(_FIRST_RULE + n)] = product(made[pair[0]], made[pair[1]])
    return made


def shortened(text: str, rules: dict[str, str]) -> str:
    """text with its pairs replaced, from left to right."""
    out, at = [], 0
    while at < len(text):
        rule = rules.get(text[at : at + 2])
        out.append(rule or text[at])
        at += 2 if rule else 1
    return "".join(out)


def chosen(pairs: list[str], limit: int) -> list[str]:
    """Pairs, most frequent first, of which none can overlap another one taken."""
    lefts, rights, taken = set(), set(), []
    for pair in pairs:
        x, y = pair
        if len(taken) == limit:
            break
        if x == y and (x in lefts or x in rights) or x != y and (x in rights or y in lefts):
            continue
        lefts |= {x, y} if x == y else {x}
        rights |= {x, y} if x == y else {y}
        taken.append(pair)
    return taken


def grammar(strings: DataFrame, limit: int = RULES) -> tuple[DataFrame, list[str]]:
    """strings (symbols, weight) with ``short``, their form after Re-Pair, and the rules: at most limit pairs."""
    table, rules = strings.withColumn("short", F.col("symbols")), []
    for _ in range(ROUNDS):
        size = F.length("short")
        pairs = table.where(size > 1).select("weight", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.col("short").substr(i, F.lit(2)))).alias("pair"))
        pairs = pairs.groupBy("pair").agg(F.sum("weight").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "pair").limit(limit)
        taken = chosen([r["pair"] for r in pairs.collect()], limit - len(rules))
        if not taken:
            break
        names = {pair: chr(_FIRST_RULE + len(rules) + i) for i, pair in enumerate(taken)}
        rules += taken
        shorten = F.pandas_udf(lambda texts, names=names: texts.map(lambda t: shortened(t, names)), "string")
        table = written(table.withColumn("short", shorten("short")), "repair-grammar")
    return table, rules


@cache
def _known(rules: tuple[str, ...]) -> dict[str, list]:
    """The worker's matrices of a grammar."""
    return matrices(list(rules))


WAYS = "array<struct<i: int, j: int, cost: bigint, audit: string>>"


def ways(shorts: pd.Series, rules: tuple[str, ...]) -> pd.Series:
    """The matrices of strings after Re-Pair, audits spelled out."""
    known, out = _known(rules), []
    for text in shorts:
        made = reduce(product, (known[c] for c in text))
        out.append([{"i": n // 4, "j": n % 4, "cost": e[0], "audit": str(e[1])} for n, e in enumerate(made) if e])
    return pd.Series(out)


def _fold(batches):
    """Cost and audit of every conversation from its chunks, which lie together and in order."""
    last, state, done = None, None, []

    def ended():
        cost, audit = reduce(better, product(state, _END)[:4])
        done.append((last[0], cost, str(audit)))

    for batch in batches:
        for conv, found in zip(batch["conv_id"].to_pylist(), batch["ways"].to_pylist()):
            if last != (conv,):
                if last is not None:
                    ended()
                last, state = (conv,), [(0, Rope("")), *[None] * 15]
            made = [None] * 16
            for x in found:
                made[4 * x["i"] + x["j"]] = (x["cost"], Rope(x["audit"]))
            state = product(state, made)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (batch.schema.field("conv_id").type, pa.int64(), pa.string()))], ["conv_id", "cost", "audit"])
            kind, done = batch.schema.field("conv_id").type, []
        else:
            kind = batch.schema.field("conv_id").type
    if last is not None:
        ended()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (kind, pa.int64(), pa.string()))], ["conv_id", "cost", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows: the counts of its faults, the cost and the audit of its repair.

    rows: conv_id, turn, role, text without nulls in role and text, and tie (an array of strings that orders rows of one turn).
    """
    body = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    narrow = rows.select(
        "conv_id", "turn", "tie", initial.alias("initial"), F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("same"),
        (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    narrow = numbered(narrow, "conv_id", ["turn", "tie", "same"], "repair-rows")
    earlier = narrow.groupBy("conv_id", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    earlier = earlier.select(F.col("conv_id").alias("of"), F.col("same").alias("as"), "first")
    narrow = narrow.join(earlier, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("as")), "left")
    repeated = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(repeated, "duplicate").when(F.col("cut"), "truncated")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    narrow = narrow.withColumn("fault", fault)
    number = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    chunks = narrow.groupBy("conv_id", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol"), "initial"))).alias("rows"),
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.size(F.collect_set("turn")).alias("turns"), number("blank"), number("duplicate"), number("truncated"),
    )
    initials = F.array_join("rows.initial", "")
    legal = F.array_join(F.transform("rows", lambda r: r.symbol), "")
    chunks = chunks.select("*", legal.alias("symbols"), initials.alias("initials")).drop("rows")
    chunks = written(chunks, "repair-chunks")
    strings = written(chunks.groupBy("symbols").agg(F.count(F.lit(1)).alias("weight")), "repair-strings")
    short, rules = grammar(strings)
    spell = F.pandas_udf(lambda s, rules=tuple(rules): ways(s, rules), WAYS)
    spelled = written(short.select("symbols", "weight", spell("short").alias("ways")), "repair-ways")
    total = strings.agg(F.sum("weight")).first()[0] or 0
    parts = join_by(chunks.select("conv_id", "chunk", "symbols"), spelled, "symbols", "weight", total)
    parts = parts.select("conv_id", "chunk", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "ways")
    kind = rows.schema["conv_id"].dataType.simpleString()
    costs = parts.mapInArrow(_fold, f"conv_id {kind}, cost bigint, audit string")
    # neighbours across the ends of chunks
    before = Window.partitionBy("conv_id").orderBy("chunk")
    pairs = F.concat(F.coalesce(F.substring(F.lag("initials").over(before), -1, 1), F.lit("")), "initials")
    again = F.when(F.lag("most").over(before) == F.col("least"), 1).otherwise(0)
    counts = chunks.withColumn("turns", F.col("turns") - again).withColumn("pairs", pairs)
    legal = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.length("pairs")), lambda i: F.col("pairs").substr(i, F.lit(2))), lambda p: p.isin("su", "ua", "au")))
    counts = counts.withColumn("illegal", F.length("pairs") - 1 - legal).groupBy("conv_id").agg(
        (F.max("most") - F.min("least") + 1 - F.sum("turns")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal"))
    )
    counts = counts.withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    costs = costs.withColumnRenamed("conv_id", "of")
    return counts.join(costs, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def _apply(batches):
    """The repaired rows of conversations whose rows follow their audit, in order."""
    last, audit, at, state, n, out = None, "", 0, START, 0, []

    def inserts():
        nonlocal at, state, n
        while at < len(audit) and audit[at] == "I":
            state = ASSISTANT if state == USER else USER
            out.append((last[0], n, "assistant" if state == ASSISTANT else "user", "", "I"))
            at, n = at + 1, n + 1

    def sent(kind):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "n", "role", "text", "edit"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, found, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if last != (conv,):
                inserts()
                last, audit, at, state, n = (conv,), found, 0, START, 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = ASSISTANT if state == USER else USER
                role = "assistant" if state == ASSISTANT else "user"
            else:
                state = _NEXT[role[0]][state]
            out.append((conv, n, role, text, edit))
            n += 1
        if out:
            yield sent(kind)
            out = []
    inserts()
    if out:
        yield sent(kind)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, n (from 0), role, text, edit (K, R or I).

    rows and found as in and from ``audits``. A conversation's rows lie in one partition, together and in order.
    """
    first = found.select("conv_id", F.lit(0).alias("after"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast(rows.schema["tie"].dataType).alias("tie"), F.lit(None).cast("binary").alias("same"), "audit", F.lit("").alias("role"), F.lit("").alias("text"))
    same = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rest = rows.select("conv_id", F.lit(1).alias("after"), "turn", "tie", same.alias("same"), F.lit("").alias("audit"), "role", "text")
    both = first.unionByName(rest).repartition("conv_id").sortWithinPartitions("conv_id", "after", "turn", "tie", "same")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_apply, f"conv_id {kind}, n bigint, role string, text string, edit string")


def text_hashes(rows: DataFrame) -> DataFrame:
    """conv_id and sha256 of ``role:text`` of the rows of each conversation, newline-joined; rows as from ``repaired``."""

    def hashed(batches):
        last, state, kind, done = None, None, None, []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if last != (conv,):
                    if last is not None:
                        done.append((last[0], state.hexdigest()))
                    last, state = (conv,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (kind, pa.string()))], ["conv_id", "sha256"])
                done = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], kind), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(hashed, f"conv_id {kind}, sha256 string")


def whole(conversations: DataFrame) -> DataFrame:
    """Rows as ``audits`` takes them, with the nulls of role and text as one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("tie", F.array("role", F.md5("text")))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn``: of 20, 0 drops the row, 1 empties its text, 2 removes its
    stops, 3 repeats it, 4 makes it a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("draw", F.crc32(key.cast("binary")) % 20).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copy = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", copy).withColumn("tie", F.concat("tie", F.array(F.col("copy").cast("string")))).drop("draw", "copy")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audits and the repaired rows of conversations."""
    found = written(audits(rows), "repair-audits")
    return found, repaired(rows, found)
