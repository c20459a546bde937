"""The rule ledger against a plain Python version."""

from llm_helpers import measures

from tallyspark.llm import rule_ledger as L

TEXTS = [
    None, "", " \n\t ", "one", "  a\x0bb\x0cc\r\nd", "a b c d e f g h " * 3, "x " * 40, "l1 w\nl1 w\n\nl1 w \n", "Straße 漢字 # * | <a>",
    "a b c d e f g h i j k a b c d e f g h i z " + "q r s " * 2, "word " * 7, "é" * 5000, " ".join(f"w{i}" for i in range(3000)) + " " + " ".join(f"w{i}" for i in range(10)),
]


def test_measures(spark, make_docs):
    rows = {r.doc_id: r for r in L.decided(make_docs(list(enumerate(TEXTS)), extra=("n_words", "kept", "__w"))).collect()}
    for i, text in enumerate(TEXTS):
        r, want = rows[i], measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_policies_and_ablations(spark, make_docs):
    good = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(30))
    docs = make_docs([(1, good), (2, "short"), (2, "short"), (3, good.replace("word", "#$")), (None, good), (4, "again " * 50)])
    book = L.ledger(docs).cache()
    kept = [(r.doc_id, r.kept_v1) for r in L.verdicts(book).collect()]
    assert sorted(kept, key=str) == sorted([(1, True), (2, False), (2, False), (3, False), (None, True), (4, False)], key=str)
    rows = {(r.policy, r.without): (r.n_kept, r.n_docs) for r in L.ablations(book).collect()}
    assert rows["v1", None] == (2, 6) and rows["base", None] == (3, 6)
    for name, rules in L.POLICIES.items():
        for rule in rules:
            m = L.mask(tuple(r for r in rules if r != rule))
            assert rows[name, rule][0] == book.filter(f"fail_bits & {m} = 0").count()
    book.unpersist()
    assert L.decided(make_docs([])).count() == 0
