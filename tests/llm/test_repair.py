import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

from pyspark.sql import functions as F

from pourscale.llm import queries, repair

TURNS = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        tie = (role, hashlib.md5(text.encode()).digest())
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        out += [(conv, turn, tie, role, text)] * (2 if draw == 3 else 1)
    return sorted(out, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0), *r[2:]))


def cheapest(initials, faults):
    """Least (cost, audit) by trying, row by row, every edit in every state of the pattern."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(at, state, inserted):
        found = []
        if at == len(initials) and state in ("", "a"):
            found.append((0, ""))
        if inserted < 2:
            for role in "ua":
                if (state, role) in step:
                    cost, audit = best(at, step[state, role], inserted + 1)
                    found.append((cost + 5, "I" + audit))
        if at < len(initials):
            extra = 5 * (faults[at] == "truncated")
            ways = [("D", 2, state)]
            if faults[at] not in ("blank", "duplicate"):
                ways += [("K", extra, step[state, initials[at]])] if (state, initials[at]) in step else []
                ways += [("R", 1 + extra, step[state, r]) for r in "ua" if (state, r) in step]
            for name, price, to in ways:
                cost, audit = best(at + 1, to, 0)
                found.append((cost + price, name + audit))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def brute(given):
    rows, out = damage(given), {}
    for conv in {r[0] for r in given}:
        mine = [r for r in rows if r[0] == conv]
        turns = [r[1] for r in mine if r[1] is not None]
        seen, faults = set(), []
        for _, _, _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[3][:1] for r in mine]
        cost, audit = cheapest(tuple(initials), tuple(faults))
        made, at, state = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else mine[at][3:]
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else "assistant" if state == "u" else "user"
                state = role[0]
                made.append(f"{role}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def asked(spark, given, tmp_path, extra=None):
    table = spark.createDataFrame(given, TURNS)
    (table if extra is None else extra(table)).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    rows = queries.op11_structure_repair(spark, str(tmp_path)).collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def conversations(seed, n):
    draw, out = random.Random(seed), []
    texts = ["a b.", "c d!", "e", "", " \t", "f?\n", None, "né. ", " ", "x" * 5000 + "."]
    for conv in range(n):
        for turn in range(draw.randint(1, 9)):
            out.append((conv, draw.choice([turn, turn, turn, None, turn + 3]), draw.choice(["user", "assistant", "system", "tool", "user", "assistant", "", None, "u"]), draw.choice(texts)))
    return out + [(None, None, None, None), (None, 1, "user", "hello."), (None, 1, "user", "hello.")]


def test_equal_to_brute_force_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    given = conversations(1, 150)
    assert asked(spark, given + given[:40], tmp_path, lambda t: t.withColumn("pos", F.lit(1)).withColumn("fault", F.lit("x"))) == brute(given + given[:40])


def test_long_conversation_over_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 4)
    draw = random.Random(3)
    given = [(7, t, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["a.", "b", "", f"{t}.", f"{t}"])) for t in range(300)]
    given += conversations(5, 10)
    assert asked(spark, given, tmp_path) == brute(given)


def test_empty_table_and_conversations_that_lose_all_rows(spark, tmp_path):
    assert asked(spark, [], tmp_path) == {}
    gone = [(c, 0, "user", "a.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and set(asked(spark, gone, tmp_path).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_rules_mean_what_their_symbols_mean():
    draw = random.Random(2)
    words = ["".join(draw.choice("xsuaoSUAO") for _ in range(12)) for _ in range(40)]
    rules, names = [], {}
    for pair in [w[i : i + 2] for w in words for i in range(11)]:
        if pair not in names and len(rules) < 30:
            names[pair] = chr(repair._FIRST_RULE + len(rules))
            rules.append(pair)
    known = repair.matrices(rules)
    for word in words:
        short = repair.shortened(word, names)
        assert len(short) < len(word)
        spelled = [[(e[0], str(e[1])) if e else None for e in repair.reduce(repair.product, (known[c] for c in w))] for w in (word, short)]
        assert spelled[0] == spelled[1]


def test_ropes_compare_as_their_strings():
    draw = random.Random(4)
    ropes = [repair.Rope("".join(w)) for n in range(4) for w in product("DIK", repeat=n)]
    for _ in range(300):
        ropes.append(repair.joined(draw.choice(ropes), draw.choice(ropes)))
    for _ in range(3000):
        a, b = draw.choice(ropes), draw.choice(ropes)
        assert (a < b) == (str(a) < str(b))


def test_pairs_taken_at_once_cannot_overlap():
    taken = repair.chosen(["ab", "bc", "ca", "cc", "ad", "dd", "ee"], 10)
    assert taken == ["ab", "ad", "cc"] or all(x[1] != y[0] for x in taken for y in taken if x != y)
    assert len(repair.chosen(["ab", "ad"], 1)) == 1
