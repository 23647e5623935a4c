"""Problems 8 and 9 on hand-made texts and against brute force."""

import random

import pytest

from sparkloom.llm.leaks import SEED, Patterns, leaked_items, leaked_passages, passage, words_of
from sparkloom.llm import truncation
from sparkloom.llm.truncation import cut_rates, judged, shape_of, strict_prefixes

ITEM = (
    "The nested avatar resizer double counts all idle invitations after somebody renames the invoice to catalog so private entry notes enter the zone search "
    "while every late monitor detector forgets the expiry of borrowed parcel leases and two cache schedulers share one mirror"
)
STOCK = "Do not comment on formatting or naming only report problems that can change the behaviour of the program"


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, item_id string, edits int"),
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, words int"),
    )


def leaks(spark, docs, items=((1, ITEM),), **options):
    return {(r.doc_id, r.item_id) for r in leaked_passages(*tables(spark, docs, items), **options).collect()}


def test_leaks(spark):
    w = ITEM.split()
    changed = [*w[:24]]
    changed[7], changed[17] = "many", "folder"
    missing = w[3:11] + w[12:28]
    docs = [
        (1, "x " + " ".join(w[4:19]) + " y"), (2, " ".join(w[4:15])), (3, "Hello, **" + " ".join(w[2:22]).upper().replace(" ", ",\n// ") + "**"), (4, " ".join(changed)), (5, " ".join(missing)),
        (6, " ".join(w[i] if i % 4 else "zz" for i in range(30))), (7, None), (8, ""), (9, STOCK), (None, ITEM), (10, "word " * 60000 + " ".join(w[:20])), (11, " ".join(w[:20])), (11, " ".join(w[:20])), (12, "<b>" + "</b> <i>".join(w[:18])),
    ]
    items = [(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, "too short"), *[(k, STOCK + " " + " ".join(f"own{k}word{j}" for j in range(20))) for k in range(10, 15)]]
    assert leaks(spark, docs, items) == {(d, 1) for d in (1, 3, 4, 5, 10, 11, 12)}
    assert leaks(spark, docs, items, block_words=30) == {(d, 1) for d in (1, 3, 4, 5, 10, 11, 12)}
    assert leaks(spark, docs, []) == set() and leaks(spark, [], items) == set()
    (row,) = leaked_items(leaked_passages(*tables(spark, docs, items))).collect()
    assert row.item_id == 1 and row.n_documents == 7


def test_occurrences_equal_brute_force():
    rnd = random.Random(9)
    for _ in range(60):
        items = {k: ([rnd.choice("abcdefg") for _ in range(rnd.randrange(3, 30))], frozenset()) for k in range(4)}
        text = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.8:
            k = rnd.randrange(4)
            text[10:10] = items[k][0]
        patterns = Patterns(items)
        got = patterns.occurrences([patterns.ids.get(x, 0) for x in text])
        want = {(k, d, i) for k, (w, _) in items.items() for i in range(len(w) - SEED + 1) for d in range(len(text) - SEED + 1) if w[i : i + SEED] == text[d : d + SEED]}
        assert {(k, d, i) for k, hits in got.items() for d, i in hits} == want


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_passages_equal_brute_force():
    """A passage is found exactly if some stretch of the item is in the text with few enough edits."""
    rnd = random.Random(5)
    for _ in range(60):
        item = list(range(1, 27))
        text = item[rnd.randrange(8) : rnd.randrange(18, 27)]
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(text))
            text[at : at + rnd.randrange(2)] = [0] * rnd.randrange(2)
        text = [0, 0, *text, 0]
        patterns = Patterns({1: ([str(x) for x in item], frozenset())})
        hits = patterns.occurrences([patterns.ids.get(str(x), 0) for x in text]).get(1)
        got = passage(text, item, hits, 15, 1 / 8)[0] if hits else 0
        ends = [(a, b) for a in range(26) for b in range(a + 15, 27) if item[a] in text and item[b - 1] in text]
        want = any(_edits(item[a:b], text[text.index(item[a]) : text.index(item[b - 1]) + 1]) <= (b - a) / 8 for a, b in ends)
        assert bool(got) == want and (not got or got >= 15)


def test_edits_count_in_short_passages_too(spark):
    w = ITEM.split()
    three = [*w[:14]]
    three[5], three[8], three[11] = "many", "folder", "later"
    one = [*w[:15]]
    one[2] = "many"
    docs = [(1, " ".join(three)), (2, " ".join(w[:14])), (3, " ".join(one)), (4, "<a href='" + "x" * 300 + "'>" + "</a> ".join([" ".join(w[:9]), "<p id='" + " q" * 200 + "'>", " ".join(w[9:16])]))]
    assert leaks(spark, docs) == {(3, 1), (4, 1)}


def test_words_of():
    assert words_of("Half-writ-\n// ten, <b>Bold</b>\\nnext &amp; ünd") == ["half", "written", "bold", "next", "ünd"]


COMPLETE = ["Fine here.", "Is it?", "Quoted \"end.\"", "See:\n\n```\nx = 1\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "Done.\n\nhttps://a.b.example/x/12", "Ok.\n\nRefs: #12, #34", "Ok.\n\nSigned-off-by: x <a@b.example>", "好的。"]
OPEN = ["lgtm, ship it", "OK for me...", "All is done. ...", "Good.…", "Ok.\n\nThanks", "Ok.\n\n-- \nnightly bot", "can't reproduce", "Left out the rest etc..."]
CUT = ["The timer of the wor", "Wait for it. See https://exa", "Code:\n\n```\nx = (1", "| a | b |\n|---|---|\n| 1 | 2", "One. Two thr... ", "One. Two [truncated]", "One two three (more)", "Broken �", "Ok.\n\nSigned-off-by: x <a@b", "One, two,", "旧的逻辑没有检查权限可能暴露", "Fine.\n\nThe linter is r", "Intro.\n\n## Risks"]


@pytest.mark.parametrize("shape,texts", [("complete", COMPLETE), ("open", OPEN), ("cut", CUT)])
def test_shapes(shape, texts):
    assert {t: shape_of(t) for t in texts} == dict.fromkeys(texts, shape)
    assert shape_of("Ok.\n\n- late timer\n- cold yard") == "item" and shape_of("Ok.\n\n- late timer\n- cold") == "cut"


def verdicts(spark, rows):
    return judged(spark.createDataFrame([(i, t, s, 1, "clash") for i, t, s in rows], "doc_id bigint, text string, source string, n_chars int, key string"))


def test_judged(spark):
    padded = [(100 + i, ("Next: " + "x" * i + " the").ljust(40, "y"), "capped") for i in range(5)]
    rows = [
        (1, "All good here.", "a"), (2, "All good he", "a"), (3, "All good he", None), (4, None, "a"), (5, "  \n", "a"), (6, "Ok.\n\n- late timer\n- cold wind", "b"), (7, "The window and another window are open.", "b"), (8, "Ok.\n\n- late timer\n- cold window", "b"),
        (9, "thanks, merged", "c"), (10, "thanks, merged and deployed to every host.", "c"), (11, "word. " * 40000, "d"), (12, "word. " * 40000 + "wor", "d"), *padded,
    ]
    got = {r.doc_id: r for r in verdicts(spark, rows).collect()}
    assert {i for i, r in got.items() if r.is_cut and i < 100} == {2, 3, 6, 9, 12}
    assert set(got) == {1, 2, 3, 6, 7, 8, 9, 10, 11, 12, *range(100, 105)} and got[9].has_longer and got[6].ends_in_word and not got[8].is_cut
    assert all(got[i].at_limit and got[i].is_cut for i in range(100, 105))
    rates = {r.source: (r.n_texts, r.n_cut) for r in cut_rates(verdicts(spark, rows)).collect()}
    assert rates["a"] == (2, 1) and rates[""] == (1, 1)
    assert verdicts(spark, []).count() == 0


def test_complete_texts_at_the_limit_are_kept(spark):
    rows = [(i, ("a" * (i + 1)).ljust(59, "b") + ".", "s") for i in range(8)]
    assert not any(r.is_cut for r in verdicts(spark, rows).collect())


def test_long_tables_and_foreign_words(spark):
    table = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 90
    assert shape_of(table + "| 1 |") == "cut" and shape_of(table + "| 1 | 2 |") == "complete" and shape_of("| x |\n\n" + table + "| 1 | 2 |") == "complete"
    rows = [
        (1, "Gut.\n\n- späte Uhr\n- kalte Prüf", "a"), (2, "Die Prüfung und noch eine Prüfung laufen.", "a"), (3, "Gut.\n\n- späte Uhr\n- kalte Prüfung", "a"),
        (4, "Ok.\n\n- late timer\n- cold " + "w" * 60, "b"), (5, "The " + "w" * 90 + " and " + "w" * 90 + " are open.", "b"),
    ]
    assert {r.doc_id for r in verdicts(spark, rows).where("is_cut").collect()} == {1, 4}


@pytest.mark.parametrize("hot,chars,few", [(100_000, 256, 1_000_000), (2, 1, 1_000_000), (5, 2, -1)])
def test_strict_prefixes_equal_brute_force(spark, monkeypatch, hot, chars, few):
    """Also where many texts share their beginnings, and where nothing is broadcast."""
    for name, value in (("HOT_TEXTS", hot), ("RANGE_CHARS", chars), ("BROADCAST_ROWS", few)):
        monkeypatch.setattr(truncation, name, value)
    rnd = random.Random(6)
    texts = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) for _ in range(200)} | {"é", "é中", "é中x", "z" * 300, "z" * 400})
    rows = spark.createDataFrame([(t, t) for t in texts] + [("ab", "ab")] * 3, "key string, text string").repartition(5)
    got = sorted(r.key for r in strict_prefixes(rows).collect())
    everything = set(texts) | {"ab"}
    assert got == sorted(t for t in everything if any(x != t and x.startswith(t) for x in everything))
