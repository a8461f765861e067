import hashlib
import random
import re

import pytest

from skein.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, conv string, root int, place int"


def order(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(chat.reply_order(df, **options).collect(), key=lambda r: (str(r.conv_id), r.part))


def test_replies_follow_their_thread_without_quotes(spark):
    rows = [
        (1, 0, "user", "Where does the river rise?"),
        (1, 1, "assistant", "What is the time in Lima?"),
        (1, 2, "user", "On Monday, Ann wrote:\n> Where does  the RIVER rise?\nIn the hills."),
        (1, 3, "user", ">> Where does the river rise?\n> In the hills.\nWhich hills?"),
        (1, 4, "assistant", "> What is the time in Lima?\n\nNoon."),
        (1, 5, "user", "> never said before\nhm"),
        (2, 0, "user", "> In the hills.\nalone"),
    ]
    one, two = order(spark, rows)
    want = ["<|user|>\nWhere does the river rise?\n", "<|user|>\nIn the hills.\n", "<|user|>\nWhich hills?\n", "<|assistant|>\nWhat is the time in Lima?\n", "<|assistant|>\nNoon.\n", "<|user|>\nhm\n"]
    assert one.chat == "".join(want)
    assert (one.n_messages, one.n_replies) == (6, 3) and one.n_links >= 4
    assert (two.chat, two.n_replies) == ("<|user|>\nalone\n", 0)


def reading(rows, part=512):
    """What reply_order gives, message by message."""
    norm = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" ").lower()
    convs = {}
    for c, t, role, text in sorted(rows):
        lines = []
        for x in text.split("\n"):
            m = re.match(r"[ \t>]*>", x)
            lines.append((m[0].count(">"), re.sub(r"^[ \t]", "", x[m.end() :])) if m else (0, x))
        after = [*lines[1:], (0, "")]
        lines = [x for x, y in zip(lines, after, strict=True) if not (x[0] == 0 and y[0] > 0 and re.match(r"(?i)\s*on\b.{1,200}\bwrote:\s*$", x[1]))]
        said, run = set(), []
        for x in [*lines, (-1, "")]:
            if run and (x[0] != run[0][0] or not x[1].strip(" ") or not run[0][1].strip(" ")):
                said.add((run[0][0], norm(" ".join(y for _, y in run))))
                run = []
            run.append(x)
        said |= {(n, norm(y)) for n, y in lines}
        own = "\n".join(y for n, y in lines if not n)
        if any(n for n, _ in lines):
            own = re.sub(r"\n{3,}", "\n\n", own).strip(" \t\r\n")
        convs.setdefault(c, []).append((t, role, own, {x for x in said if x[1]}))
    out = []
    for c, ms in convs.items():
        root, done = {}, []
        for t, role, own, said in ms:  # turns rise, so a parent is known before
            traced = [(len(q), s, n) for n, q in said if n and (s := min((u for u, _, _, x in ms if (0, q) in x), default=t)) < t]
            parent = max(((z, s) for z, s, n in traced if n == 1), default=(0, None))[1]
            root[t] = root[parent] if parent is not None else t
            done.append((root[t], t, role, own, parent is not None, len(traced)))
        done.sort()
        for at in range(0, len(done), part):
            some = done[at : at + part]
            out.append((c, at // part, len(some), sum(x[4] for x in some), sum(x[5] for x in some), "".join(f"<|{x[2]}|>\n{x[3]}\n" for x in some)))
    return sorted(out)


def replies(seed, conversations=12, hot=300):
    """Conversations with quotes of several levels, announced or not, in part or whole, of messages that repeat each other; one holds most messages."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("red Blue green  sky sea tree".split()) for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    rows = []
    for c in range(conversations):
        said = []
        for t in range(hot if not c else rng.randrange(1, 12)):
            body = []
            for _ in range(rng.randrange(1, 4)):
                if said and rng.random() < 0.6:
                    lines = rng.choice(said).split("\n")
                    a = rng.randrange(len(lines))
                    body += (["On Monday, Ann wrote:"] if rng.random() < 0.3 else []) + [rng.choice(["> ", ">", " > ", "> > "]) + x for x in lines[a : a + rng.randrange(1, 5)]]
                body += rng.choice([[rng.choice(pool)], [rng.choice(pool), rng.choice(pool)], ["", "", "", rng.choice(pool)], [f"own {rng.random()}"], ["On wrote:", "wrote:"]])
            said.append("\n".join(body))
            rows.append((c, t * (1 + c % 3), rng.choice(["user", "assistant"]), said[-1]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_as_read_message_by_message_and_by_sql(spark, seed):
    import duckdb
    import pyarrow as pa

    rows = replies(seed)
    got = order(spark, rows)
    assert sorted(map(tuple, got)) == reading(rows)
    assert sum(r.n_replies for r in got) > 100 and sum(r.n_links for r in got) > 200
    conversations = pa.table({n: [r[i] for r in rows] for i, n in enumerate(("conv_id", "turn", "role", "text"))})
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.execute(chat.ORACLE).fetchall()
    assert sorted(want) == sorted((*r[:5], hashlib.sha256(r[5].encode()).hexdigest()) for r in reading(rows))


def test_many_messages_without_conversation_and_turn(spark):
    (got,) = order(spark, [(None, None, "user", f"message {i}") for i in range(400)])
    assert got.n_messages == 400 and len(set(got.chat.split("\n"))) == 402


def test_passages_of_several_lines_and_long_chains(spark):
    rows = [(1, 0, "a", "first line\nsecond line\n\nother")] + [(1, 1, "b", "> first line\n> second line\nok 1")]
    rows += [(1, i, "c", f"> ok {i - 1}\nok {i}") for i in range(2, 40)]
    (got,) = order(spark, rows)
    assert got.n_messages == 40 and got.n_replies == 39
    assert got.chat.index("ok 38") < got.chat.index("ok 39")


def test_parts_are_bounded(spark):
    rows = [(7, i, "user", f"message {i}") for i in range(70)]
    got = order(spark, rows, part=32)
    assert [r.n_messages for r in got] == [32, 32, 6]
    assert "".join(r.chat for r in got) == "".join(f"<|user|>\nmessage {i}\n" for i in range(70))


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", ""), (3, 2, "user", "same"), (3, 2, "user", "same"), (4, 0, "user", ">"), (5, 0, "user", "> " * 5000), (5, 1, "u", "x" * 100_000)]
    got = order(spark, rows)
    assert sum(r.n_messages for r in got) == len(rows)
    assert next(r for r in got if r.conv_id == 3).chat == "<|user|>\nsame\n" * 2
    assert next(r for r in got if r.conv_id is None).chat == "<|user|>\n\n<|unknown|>\n\n"
    assert order(spark, []) == []
