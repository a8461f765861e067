import hashlib
import random
import re

import pytest

from odd import ODD

from skein.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    """The patterns as they are stated, without the guards that keep long runs linear."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_patterns_on_random_texts():
    rng = random.Random(6)
    parts = ["a", "b.", "@", "@x", ".", "-", "1", "255", "256.", "1.2.3.4", "0007", " ", "+", "+1 (", ")", "%", "é", "4644348398010899", "4111 1111 1111 1111", "+1 (706) 555-3138", "me@a.b", "\n", "_", "😀"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(t) == brute(t), repr(t)


def test_long_runs_are_linear():
    for part in ("a", "1", "1.", "@", "+1 ", "a@", "1 ", "%", "a.b"):
        pii.base_spans(part * (400_000 // len(part)))


def test_disclosing_terms(docs_of):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n))
    rows = [(i, f"{words(20)} quillfeather writes from q.f@corp.example {words(20)}", "s") for i in range(6)]
    rows += [(10, f"{words(9)} Quillfeather alone {words(9)}", "s"), (11, words(30), "s"), (12, f"{words(5)} other@mail.example {words(5)}", "s")]
    rows += [(20 + i, words(25), "s") for i in range(40)]
    got = {r.doc_id: r for r in pii.find(docs_of(rows), redacted=True).collect()}
    assert "[HINT]" in got[10].clean and "Quillfeather" not in got[10].clean  # the name gives the address away
    assert got[11].spans == "" and got[11].clean == rows[7][1]
    assert "term" not in got[12].spans and "hint" not in got[12].spans  # common words give nothing away, and one context proves nothing
    assert "[EMAIL]" in got[0].clean and got[0].spans.startswith(got[0].base)
    a = next(s.split(":") for s in got[10].spans.split(","))
    assert rows[6][1][int(a[1]) : int(a[2])] == "Quillfeather"


def test_odd_rows(docs_of):
    rows = ODD + [(20, "x@y.zz +1 (706) 555-3138", "a")]
    got = pii.find(docs_of(rows, extra=True)).collect()
    want = sorted((str(i), ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.base) for r in got) == want
    assert [tuple(r)[1:5] for r in got if r.doc_id == 20] == [(1, 0, 0, 1)]
    assert pii.find(docs_of([])).collect() == []
    assert hashlib.sha256(b"").hexdigest()[:8] == "e3b0c442"


def test_evidence_and_thresholds(docs_of):
    """Several contexts in one document count; one sighting is never enough; strong terms go, weaker ones are generalised."""
    filler = [f"{' '.join(f'w{chr(97 + i % 26)}{chr(97 + j)}' for j in range(20))} common" for i in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(filler)]
    rows += [(500, "common zanthor writes from z.x@corp.example today", "s"), (501, "about zanthor", "s")]
    near = lambda name, n: " ".join(f"{4 * a} {name} at {name}@corp.example {4 * a}q " + "pad " * 8 for a in "abcdefghijklmnopqrst"[:n])
    rows += [(502, near("plumwick", 5), "s"), (503, "about plumwick", "s"), (504, near("thornby", 20), "s"), (505, "about thornby", "s"), (506, near("oxlade", 2), "s"), (507, "about oxlade", "s")]
    got = {r.doc_id: r for r in pii.find(docs_of(rows), redacted=True).collect()}
    assert got[503].spans == "hint:6:14" and got[503].clean == "about [HINT]"  # five contexts against one document without the entity
    assert got[505].spans == "term:6:13" and got[505].clean == "about "  # twenty against one
    assert got[507].spans == ""  # two against one
    assert got[500].spans == got[500].base and got[501].spans == ""
    assert got[0].spans == ""


def test_marks_as_counted_one_by_one(docs_of):
    rng = random.Random(7)
    names = ["quill", "thorn", "marsh", "ember"]
    rows = []
    for i in range(160):
        w = [rng.choice(["alpha", "beta", "gamma", "delta", *names]) for _ in range(rng.randrange(4, 30))]
        for _ in range(rng.randrange(3)):
            n = rng.choice(names)
            w[rng.randrange(len(w))] = rng.choice([f"{n} {n}@corp.example", f"{n}@corp.example", f"10.0.0.{names.index(n)}"])
        rows.append((i, " ".join(w), "s"))
    rows += rows[:7]
    contexts, both, held, entities = {}, {}, {}, {}
    for _, t, _ in rows:
        words = [(*m.span(), m[0].lower()) for m in pii._TERM.finditer(t)]
        for w in {w for *_, w in words}:
            held[w] = held.get(w, 0) + 1
        pairs = set()
        for k, a, z in pii.base_spans(t):
            before, after = pii._near(words, a, z)
            e = pii._entity(k, t[a:z])
            for w in {*before, *after}:
                contexts.setdefault((e, w), set()).add((*before, k, *after))
                pairs.add((e, w))
        for p in pairs:
            both[p] = both.get(p, 0) + 1
    chance = {}
    for (e, w), c in contexts.items():
        if len(c) >= pii.CONTEXTS:
            chance[w] = max(chance.get(w, 0), pii.disclosure(len(c), max(held[w] - both[e, w], 0)))
    for low, high in ((0.02, 0.05), (0.5, 0.8)):
        marked = 0
        for r in pii.find(docs_of(rows), disclosed=low, removed=high).collect():
            t = rows[r.doc_id][1]
            want = [f"{'term' if chance[w] >= high else 'hint'}:{m.start()}:{m.end()}" for m in pii._TERM.finditer(t) if chance.get(w := m[0].lower(), 0) >= low]
            assert r.spans == ",".join([r.base] * bool(r.base) + want)
            marked += len(want)
        assert marked or low > 0.1


@pytest.mark.parametrize("size", [150, 3000])
def test_planted_names_at_any_size(docs_of, size):
    """Twelve names that stand by their own address in six documents and alone in one; all else is common or stands once."""
    rng = random.Random(size)
    common = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    once = lambda: "".join(rng.choice("klmnopqrstuvwxyz") for _ in range(12))
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.97 else once() for _ in range(n))
    names = [once() for _ in range(12)]
    rows = [(i, f"{text(40)} user{i}@some.example {text(40)}" if i % 9 == 0 else text(80), "s") for i in range(size)]
    rows += [(100_000 + 10 * i + j, f"{text(30)} {n} {n}@corp.example {text(30)}" if j < 6 else f"{text(20)} {n} {text(20)}", "s") for i, n in enumerate(names) for j in range(7)]
    texts = {i: t for i, t, _ in rows}
    marked = [texts[r.doc_id][int(a) : int(b)] for r in pii.find(docs_of(rows)).collect() for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k in ("term", "hint")]
    right = [m for m in marked if m in names]
    print(f"{size} documents: precision {len(right) / len(marked):.3f}, recall {len(right) / sum(t.count(n) for t in texts.values() for n in names):.3f}")
    assert len(right) >= 0.95 * len(marked) and set(right) == set(names)
