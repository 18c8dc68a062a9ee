"""Conversation repair against a search over all edits, and its memory."""

import functools
import hashlib
import itertools
import random
import re
import zlib

from webloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, conv int, walk string, code int, place string, own long"
_PATTERN = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(name.encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] + ":" + hashlib.md5(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Least (cost, edits) and the lines they leave, over all edits with at most three
    insertions between two rows (more would insert a pair for nothing)."""

    def step(state, initial):
        return initial != "" and initial in {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    @functools.cache
    def go(i, state, left):
        out = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for role in ("user", "assistant"):
            if left and step(state, role[0]):
                out += [(c + 2, "I" + e, (role + ":", *lines)) for c, e, lines in go(i, role[0], left - 1)]
        if i < len(rows):
            _, _, role, text = rows[i]
            out += [(c + 3, "D" + e, lines) for c, e, lines in go(i + 1, state, 3)]
            for cost, edit, to in [(0, "K", role), (2, "R", "user"), (2, "R", "assistant")]:
                if kinds[i] in (0, 3) and step(state, to[:1]):
                    out += [(c + cost + (kinds[i] == 3), edit + e, (f"{to}:{text}", *lines)) for c, e, lines in go(i + 1, to[:1], 3)]
        return [min(out)] if out else []

    return go(0, "", 3)[0]


def expected(rows, originals):
    for conv in dict.fromkeys(originals):
        own = in_order([r for r in rows if r[0] == conv])
        kinds = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        cost, edits, lines = cheapest(own, kinds)
        assert _PATTERN.match("".join(x[0] for x in lines))
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count(1), kinds.count(2), kinds.count(3),
               sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "open end", "What?  \n", " \t", "", None, "x" * 3000 + ".", "Ça va.", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", "same.") for t in range(6)]
    rows += [(7, 1, "user", "Yes.")] * 2
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 2, "p", 3) for r in rows], SCHEMA)


def key(r):
    return (r[0] is None, r[0] or 0)


def test_report_equals_search_over_edits(spark):
    rows = conversations()
    got = sorted(map(tuple, C.report(frame(spark, rows)).collect()), key=key)
    assert got == sorted(expected(damaged(rows), [r[0] for r in rows]), key=key)


def test_audit_and_repaired_rows_agree(spark):
    rows = [r for r in conversations(8, 20) if r[0] is not None]
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    audit = {r.conv_id: r for r in C.audit(frame(spark, rows)).collect()}
    assert sorted(map(tuple, audit.values())) == sorted(expected(clean, [r[0] for r in clean]))
    lines = {c: [] for c in audit}
    for r in sorted(C.repair(frame(spark, rows)).collect(), key=lambda r: (r.conv_id, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for c, r in audit.items():
        assert hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == r.repaired_sha256
        assert len(lines[c]) == len(r.audit.replace("D", ""))


def test_empty_table_and_wholly_dropped_conversation(spark):
    assert C.report(frame(spark, [])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = C.report(frame(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_only_square_root_many_vectors_are_held():
    """100,000 rows of one conversation: about 317 checkpoints, and the walk of every
    block agrees with the cost found on the way back."""
    rng = random.Random(5)
    codes = bytes(rng.choice([0, 4, 8, 12, 4, 8]) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(100_000))
    edits = C.Edits(codes)
    assert len(edits.checkpoints) <= 2 * 317 + 2
    cost, i = 0, 0
    for edit, _ in edits:
        cost += {"K": 0, "R": 2, "D": 3, "I": 2}[edit]
        if edit in "KR":
            cost += codes[i] % 4 == C.TRUNCATED
        i += edit != "I"
    assert i == len(codes) and cost == edits.cost
