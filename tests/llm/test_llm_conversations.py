"""Conversation repair against a search over all edits, and long conversations over many segments."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pairlab.llm import convrepair

SCHEMA = "conv_id long, turn long, role string, text string, seg long, there string, salt int, audit string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    """The stated damage, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        here = out.setdefault(conv, [])
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        here += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """A search by (cost, letters) over prefixes; whether roles so far can be completed is a pattern's say."""
    legal = re.compile(r"(s|s?(ua)*u?)\Z")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, roles, lines = heapq.heappop(heap)
        state = (i, roles[-1:] if roles in ("", "s") else "s" + roles[-1])
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, lines
        if state in done:
            continue
        done.add(state)
        steps = [(3, "I", i, role, (f"{role}:",)) for role in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((4, "D", i + 1, "", ()))
            if bad[i] in ("", "truncated"):
                more = 3 if bad[i] else 0
                steps.append((more, "K", i + 1, role or " ", (f"{role}:{text}",)))
                steps += [(3 + more, "R", i + 1, r, (f"{r}:{text}",)) for r in ("user", "assistant")]
        for c, x, j, role, more in steps:
            if legal.match(roles + role[:1]):
                heapq.heappush(heap, (cost + c, letters + x, j, roles + role[:1], lines + more))


def brute(rows):
    out = []
    for conv, r in damage(rows).items():
        bad, turns = faults(r), [t for t, _, _ in r if t is not None]
        cost, letters, lines = cheapest(r, bad)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(r, r[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad.count("blank"), bad.count("duplicate"),
                    bad.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=4, n=150):
    r = random.Random(seed)
    text = lambda: r.choice(["Yes.", "No!", "Why?", "cut off", "end. \n", " ", "", "\x1c.", "é漢🙂.", None, f"t{r.random()}."])
    role = lambda: r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "usher", "User"])
    rows = []
    for c in range(n):
        size = r.choice([1, 1, 2, 4, 8, 13])
        rows += [(c, r.choice([t, t, t, t + 3, None]), r.choice([role(), ["user", "assistant"][t % 2]]), text()) for t in range(size)]
    rows += rows[40:60]  # repeated rows
    rows += [(None, 0, "user", "hi."), (None, None, "assistant", "ho."), (-5, 2, "system", "only.")]
    rows += [(999, t, ["user", "assistant"][t % 2], "word " * 200_000 + ".") for t in range(2)]
    dropped = next(t for t in range(10**6) if zlib.crc32(f"998:{t}".encode()) % 20 == 0)
    return rows + [(998, dropped, "user", "all rows go.")]


def run(spark, rows, parts=3):
    full = [(*x, 1, "t", 2, "a") for x in rows]
    turns = spark.createDataFrame(full, SCHEMA).repartition(parts)
    done = convrepair.reports(convrepair.prepare(convrepair.damaged(turns)))
    assert done.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(x) for x in done.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_same_as_search(spark, rows):
    expected = brute(rows)
    assert {x for e in expected for x in e[7]} == set("DIKR") and any(e[7] == "" and e[0] == 998 for e in expected)
    assert run(spark, rows) == expected


def test_long_conversations_in_segments(spark, rows, monkeypatch):
    """One conversation holds half of the rows; segments of three rows cross partitions."""
    r = random.Random(9)
    long = [(77, t // 2, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", f"c{t}.", f"c{t}", " "])) for t in range(900)]
    rows = [x for x in rows if x[0] != 77 and x[0] != 999] + long + [(None, t, r.choice(["user", "assistant"]), f"n{t}.") for t in range(30)]
    monkeypatch.setattr(convrepair, "SEGMENT_ROWS", 3)
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(convrepair, "SEGMENT_ROWS", 4096)
    monkeypatch.setattr(convrepair, "SEGMENT_BYTES", 40)
    assert run(spark, rows, 1) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_segments_agree_with_the_whole():
    r = random.Random(1)
    for _ in range(300):
        rows = [convrepair.kind(r.choice(["user", "assistant", "system", "x"]), r.randrange(4)) for _ in range(r.randrange(12))]
        whole = convrepair.walk(rows, convrepair.END, 0, True)
        cut = r.randrange(len(rows) + 1)
        behind = convrepair.through(convrepair.transfer(rows[cut:]), convrepair.END)
        first = convrepair.walk(rows[:cut], behind, 0, False)
        second = convrepair.walk(rows[cut:], convrepair.END, first[2], True)
        assert (first[0] + second[0], first[1] + second[1], second[2]) == whole
        step, kept = convrepair.checkpoints(rows, convrepair.END)
        assert len(kept) == -(-len(rows) // step) and len(kept) <= 2 * len(rows) ** 0.5 + 1
