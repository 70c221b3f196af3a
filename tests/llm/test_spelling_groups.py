import random
import re
import zlib
from collections import Counter

from riskgraph.llm import queries, spelling_groups as G
from tests.llm.helpers import DOC_SCHEMA, SF, awkward_docs, awkward_texts, no_docs, rows

FOLD = {c: c + 32 for c in range(65, 91)}


def brute_words(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1:] if len(a) < len(b) else a[k + 1:] == b[k + 1:]


def near_lists(words):
    """By deleting every code point: two words are near only if they share such a form or one is such a form."""
    where = {}
    for w in words:
        for k in range(len(w) + 1):
            where.setdefault(w[:k] + w[k + 1:], set()).add(w)
    near = {w: set() for w in words}
    for group in where.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return near


def brute(docs):
    words = brute_words(docs)
    near = near_lists(words)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_matches_brute_force(spark):
    want = brute(rows("documents", "doc_id, text"))
    assert got(queries.QUERIES["op12_spelling_groups"](spark, SF)) == want
    assert any(r[1] for r in want)


def test_awkward_rows(spark):
    docs = awkward_texts() * 3
    assert got(G.groups(awkward_docs(spark).union(awkward_docs(spark)).union(awkward_docs(spark)))) == brute(docs)


def test_empty_table(spark):
    assert got(G.groups(no_docs(spark))) == []


def words_frame(spark, words):
    docs = [(i, " ".join(words), "en", "s", 1, "k", 1, "l", 1, 1, 1) for i in range(4)]
    return docs, spark.createDataFrame(docs, DOC_SCHEMA)


def test_dense_alphabet(spark):
    """Every word over two letters of 5 to 7 code points, runs and ends included."""
    r = random.Random(3)
    words = ["".join(r.choice("abé") for _ in range(r.randint(5, 7))) for _ in range(400)]
    docs, frame = words_frame(spark, words)
    assert got(G.groups(frame)) == brute([d[:2] for d in docs])


def test_very_long_words_take_few_levels(spark, monkeypatch):
    monkeypatch.setattr(G, "SINGLE_LEVELS", 4)
    r = random.Random(4)
    base = "".join(r.choice("abc") for _ in range(300))
    words = [base, "x" * 900, "x" * 901, "x" * 902]
    for at in [0, 1, 4, 5, 7, 8, 15, 16, 17, 64, 65, 127, 128, 298, 299]:
        words += [base[:at] + base[at + 1:], base[:at] + "q" + base[at:], base[:at] + "z" + base[at + 1:]]
    words += [base + "q", base[:150]]
    docs, frame = words_frame(spark, words)
    assert got(G.groups(frame)) == brute([d[:2] for d in docs])


def test_ties_and_chains(spark):
    text = "abcde " * 40 + "abcdf " * 40 + "abcdg " * 20 + "abcdgh " * 10 + "abcdghi " * 5
    docs = [(1, text)]
    frame = spark.createDataFrame([(1, text, "en", "s", 1, "k", 1, "l", 1, 1, 1)], DOC_SCHEMA)
    assert got(G.groups(frame)) == brute(docs)
