import random

import pytest

from tesserine.llm import quotes as Q


def test_parse():
    own, wrote, quoted = Q.parse("Hi\nOn Monday Ann wrote:\n> one line more\n>> two\n> > three\n\nanswer")
    assert own == "Hi\n\nanswer" and {(q[0], q[1]) for q in quoted} == {(1, 0), (2, 1)} and Q.unit_hash("hi answer") in wrote
    assert Q.parse(None) == ("", [], []) and Q.parse("a > b")[2] == []
    assert Q.parse("X wrote:\n\n> q q q\nfine")[0] == "fine"
    assert Q.parse("Hello.\nOn Mon, 3 May 2021 at 10:00, Ann Example\n<ann@example.org> wrote:\n> q\nfine")[0] == "Hello.\nfine"
    assert Q.parse("I know.\nAnn wrote:\n> q\nfine")[0] == "I know.\nfine" and Q.parse("no quote\nAnn wrote:")[0] == "no quote\nAnn wrote:"


CHAT = [
    (1, 0, "user", "How do I sort a list?\nIn python"),
    (1, 1, "assistant", "Use sorted.\nIt returns a new list."),
    (1, 2, "user", "Unrelated: what is a tuple?"),
    (1, 5, "user", "Bob wrote:\n>  it RETURNS a new   list.\n>> How do I sort a list?\nAnd in place?"),
    (1, 7, "assistant", "> Unrelated: what is a tuple?\nAn immutable sequence."),
    (1, 8, "user", None),
    (2, 0, "user", "It returns a new list."),
    (2, 1, "user", "> no such line\nfine"),
    (None, 3, "user", "x"), (None, None, "user", "> x\ny"), (1, 8, "user", "again"),
    # the latest writer of a line that many wrote; a whole passage before its lines; a re-wrapped passage; short lines
    (3, 0, "user", "Good morning to you all\nfirst point of mine"), (3, 1, "user", "Good morning to you all\nsecond point of mine"), (3, 2, "user", "thanks"), (3, 3, "user", "thanks"),
    (3, 4, "user", "> Good morning to you all\n> second point of mine\nyes"), (3, 5, "user", "> Good morning to you all\nhello"), (3, 6, "user", "> Good morning\n> to you all first point\n> of mine\nwrapped"),
    (3, 7, "user", "> thanks\n> Good morning\n> no such thing\nshort"), (3, 8, "user", "> thanks\nwhole"),
]


def frame(spark, rows=CHAT):
    return spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)


def test_links_and_order(spark):
    got = {(r.conv_id, r.turn, r.text): r for r in Q.ordered(frame(spark)).collect()}
    assert len(got) == len(CHAT)
    want = {(1, 0): (None, False, 0, 0), (1, 1): (0, False, 0, 1), (1, 2): (1, False, 0, 2), (1, 5): (1, True, 0, 2), (1, 7): (2, True, 0, 3), (1, 8): (7, False, 0, 4), (2, 0): (None, False, 0, 0), (2, 1): (0, False, 0, 1), (None, 3): (None, False, 3, 0)}
    want |= {(3, 0): (None, False, 0, 0), (3, 1): (0, False, 0, 1), (3, 2): (1, False, 0, 2), (3, 3): (2, False, 0, 3), (3, 4): (1, True, 0, 2), (3, 5): (1, True, 0, 2), (3, 6): (0, True, 0, 1), (3, 7): (6, False, 0, 2), (3, 8): (3, True, 0, 4)}
    for (c, t, _), r in got.items():
        if t is not None:
            assert (r.reply_to, r.linked, r.root_turn, r.depth) == want[c, t], r
        else:
            assert (r.reply_to, r.root_turn, r.depth, r.position) == (None, None, None, None)
    assert got[1, 5, "And in place?"].quote_levels == 2 and (1, 7, "An immutable sequence.") in got
    assert [t for _, t in sorted((r.position, t) for (c, t, _), r in got.items() if c == 3)] == [0, 1, 6, 2, 4, 5, 7, 3, 8]
    assert sorted(r.position for (c, _, _), r in got.items() if c == 1) == list(range(7))


def brute(rows):
    """reply_to of each (conv, turn) by looking through all earlier messages."""
    own = {(c, t): [(x, k) for _, k, x in Q.units(Q.parse(text)[0].split("\n"))] for c, t, _, text in rows}
    out = {}
    for c, t, _, text in rows:
        earlier = sorted((u for d, u in own if d == c and u < t), reverse=True)
        writer = lambda h: next((u for u in earlier if any(Q.unit_hash(x) == h for x, _ in own[c, u])), None)  # noqa: B023, E731
        found = [(level, run, para, kind, n, writer(h)) for level, run, para, kind, h, n in set(Q.parse(text)[2])]
        found = [f for f in found if f[5] is not None]
        found = [f for f in found if f[3] == 0 or not any(g[1] == f[1] and g[3] == 0 for g in found)]
        found = [f for f in found if f[3] == min(g[3] for g in found if g[1:3] == f[1:3])]
        votes = {}
        for level, _, _, _, n, u in found:
            direct, every = votes.get(u, (0, 0))
            votes[u] = (direct + (n if level == 1 else 0), every + n)
        out[c, t] = max(votes, key=lambda u: (*votes[u], u)) if votes else (earlier[0] if earlier else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_quotes_against_plain_search(spark, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(1, 7))) + rng.choice(["", ".", "?"])
    common = [line() for _ in range(6)]
    rows, said = [], []
    for c in range(3):
        for t in range(0, 160, rng.choice([1, 2])):
            lines = [rng.choice(common) if rng.random() < 0.3 else line() for _ in range(rng.randint(1, 6))]
            lines.insert(rng.randint(0, len(lines)), "")
            quoted = []
            for _ in range(rng.choice([0, 1, 1, 2])):
                if said:
                    old = rng.choice(said[-50:]).split("\n")
                    a = rng.randrange(len(old))
                    part = old[a : a + rng.randint(1, 4)]
                    if rng.random() < 0.3:
                        joined = " ".join(part).split(" ")
                        part = [" ".join(joined[i : i + 4]) for i in range(0, len(joined), 4)]
                    quoted += [">" * rng.choice([1, 1, 2]) + " " + x.upper() for x in part]
            text = "\n".join([*quoted, *lines])
            said.append("\n".join(lines))
            rows.append((c, t, "user", text))
    got = Q.ordered(frame(spark, rows)).collect()
    want = brute(rows)
    assert {(r.conv_id, r.turn): r.reply_to for r in got} == want and sum(r.linked for r in got) > 100
    at = {(r.conv_id, r.turn): r for r in got}
    for r in got:
        parent = at.get((r.conv_id, r.reply_to))
        assert r.depth == (0 if parent is None else parent.depth + 1) and (parent is None or parent.position < r.position)
        assert r.root_turn == (r.turn if parent is None else parent.root_turn)


def test_long_conversation_and_long_message(spark):
    rng = random.Random(3)
    rows = [(0, 3 * i, "user", f"line {i} here" if i == 0 or rng.random() < 0.7 else f"> line {rng.randrange(i)} here\nline {i} here") for i in range(300)]
    rows.append((1, 0, "user", "a long line of text\n" * 50_000))
    rows.append((1, 1, "user", "> " + "a long line of text " * 50_000 + "\nall of it"))
    text = Q.rendered(frame(spark, rows), 100).collect()
    assert sum(r.chat.count("<|user|>") for r in text) == 302 and all(">" not in r.chat.replace("|>", "") for r in text)
    assert sorted(r.part for r in text if r.conv_id == 0) == [0, 1, 2]
    assert {r.turn: r.linked for r in Q.link(frame(spark, rows[300:])).collect()} == {0: False, 1: True}


def test_empty(spark):
    assert Q.ordered(frame(spark).limit(0)).count() == 0
