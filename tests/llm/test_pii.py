import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stacklight.llm import pii, pii_spans, pii_training
from stacklight.llm.pii_spans import KINDS, Words, propose

TEXTS = pii.TRAINING_TEXTS
#: Names are the hard kind: generated brands in name-like places, and names in small letters without a cue.
LEAST = {"name": 0.75}
REVIEWS = Path("/root/testdata/sf0.01/reviews.parquet")


def test_generators_have_high_recall():
    assert pii_training.recall_of_candidates(800, 5) > 0.95


def test_held_out_accuracy():
    model = pii.train(TEXTS)
    x, y, kinds = pii_training.labelled(600, 99, frozenset())
    p = model.trees.probability(x)
    for k, name in enumerate(KINDS):
        at = kinds == k
        chosen = p[at] >= model.thresholds[k]
        hit = (chosen & (y[at] == 1)).sum()
        least = LEAST.get(name, 0.88)
        assert hit / chosen.sum() > least and hit / y[at].sum() > least, name


def test_accuracy_on_sentences_of_other_wording():
    """Frames that no model is trained on; candidates the generators miss count as lost."""
    model = pii.train()
    maker = pii_training._Maker(7, True)
    hit, chosen, total = Counter(), Counter(), Counter()
    made = [maker.text() for _ in range(1500)]
    words = pii_training.collection_words([text for text, _ in made])
    for text, true in made:
        got = {(s.kind, s.start, s.end) for s, _ in pii.find_in([text], words, model)[0]}
        for group, spans in ((hit, got & true), (chosen, got), (total, true)):
            group.update(k for k, _, _ in spans)
    for kind in KINDS:
        least = LEAST.get(kind, 0.9)
        assert hit[kind] >= least * total[kind] and hit[kind] >= least * chosen[kind], kind


@pytest.mark.skipif(not REVIEWS.exists(), reason="no reviews at hand")
def test_no_training_sentence_stands_in_the_reviews():
    import duckdb

    texts = "\n".join(t.lower() for (t,) in duckdb.sql(f"SELECT DISTINCT text FROM '{REVIEWS}' WHERE text IS NOT NULL").fetchall())
    stand = []
    for frame in [*pii_training.frames(), *(f for group in pii_training.HELD_OUT.values() for f in group)]:
        parts = re.split(r"\{[^}]*\}", frame.lower())
        if len(re.findall(r"[^\W\d_]+", " ".join(parts))) >= 2 and re.search(r"[^.\n]{1,60}?".join(map(re.escape, parts)), texts):
            stand.append(frame)
    assert not stand


def test_the_stored_model_is_what_the_code_fits():
    kept, fresh = pii.train(), pii.fit(pii.TRAINING_TEXTS, 11)
    assert pii.json.loads(pii.STORED.read_text())["fingerprint"] == pii.fingerprint(pii.TRAINING_TEXTS, 11)
    x, _, _ = pii_training.labelled(100, 5, frozenset())
    assert kept.thresholds == fresh.thresholds and (kept.trees.probability(x) == fresh.trees.probability(x)).all()


def test_names_of_more_than_three_words():
    spans = {("Maria Josefa Ana Quintevel Rosheim", "name")}
    text = "My tailor Maria Josefa Ana Quintevel Rosheim altered it."
    assert spans <= {(text[s.start : s.end], s.kind) for s in propose(text, Words())}


def test_probabilities_are_calibrated():
    model = pii.train(TEXTS)
    x, y, _ = pii_training.labelled(600, 98, frozenset())
    p = model.trees.probability(x)
    for lo, hi in ((0.0, 0.2), (0.8, 1.01)):
        at = (p >= lo) & (p < hi)
        assert abs(p[at].mean() - y[at].mean()) < 0.06


CASES = [
    (1, "Signed, Calder von Astheim", {("name", "Calder von Astheim")}),
    (2, "Call me on (718) 555-0163 after six. SKU 4410293879 is printed on the bag.", {("phone", "(718) 555-0163")}),
    (3, "Write to thackwray_81 (at) inbox.test if you want mine.", {("email", "thackwray_81 (at) inbox.test")}),
    (4, "Courier noted SSN 666-57-4842. The style tag says 212-556-0.", {("id_number", "666-57-4842")}),
    (5, "The parcel went to Flat 9, 18 Larkspur Row, East Harrow Bay QX9 7ZZ, not to me.", {("address", "Flat 9, 18 Larkspur Row, East Harrow Bay QX9 7ZZ")}),
    (6, "I met someone at the mall @ noon who had one.", set()),
    (7, "", set()),
    (8, None, set()),
]


def test_found_and_redacted(spark):
    rows = [(k, t) for k, t, _ in CASES] + [(None, "mail a.bell@post.example"), (9, "plain words " * 3000 + "contact imke.dorn@post.example")]
    df = spark.createDataFrame(rows, "review_id long, text string").withColumn("pii_kind", F.lit("x"))
    got = {}
    for r in pii.personal_information(df, n_texts=TEXTS).collect():
        got.setdefault(r["review_id"], set()).add((r["pii_kind"], r["pii_text"]))
    for k, _, want in CASES:
        assert got.get(k, set()) == want, k
    assert got[9] == {("email", "imke.dorn@post.example")} and got[None] == {("email", "a.bell@post.example")}
    clean = {r["review_id"]: r["redacted"] for r in pii.redact(df, n_texts=TEXTS).collect()}
    assert clean[3] == "Write to [EMAIL] if you want mine." and clean[8] is None and clean[7] == "" and len(clean) == len(rows)
    assert pii.personal_information(df.limit(0), n_texts=TEXTS).count() == 0


def test_ordinary_words_count_all_texts(spark):
    df = spark.createDataFrame([(f"common rare{chr(97 + i % 26)}{chr(97 + i // 26)}",) for i in range(40)] + [(None,)], "text string")
    assert pii.ordinary_words(df, "text") == frozenset({"common"})
    assert Words(frozenset({"common"})).rare("Rareness") and not Words(frozenset({"common"})).rare("Common")


def _filled(i: int) -> str:
    return f"The parka {'faded' if i % 2 else 'shrank'} after {i} washes and the hem came loose."


def test_copied_name_is_found(spark):
    text = "My tailor Brannoc Delwyth fixed it."
    rows = [(i, text if i % 3 == 0 else _filled(i)) for i in range(300)] + [(1000, "Signed, Brannoc Ferrisham")]
    df = spark.createDataFrame(rows, "review_id long, text string")
    assert not {"brannoc", "delwyth"} & pii.ordinary_words(df, "text")
    got = {(r["review_id"], r["pii_kind"], r["pii_text"]) for r in pii.personal_information(df, n_texts=TEXTS).collect()}
    assert got == {(i, "name", "Brannoc Delwyth") for i in range(0, 300, 3)} | {(1000, "name", "Brannoc Ferrisham")}


def test_name_in_changed_copies_is_found(spark):
    rows = [(i, f"My tailor Brannoc Delwyth fixed it on day {i}." if i % 3 == 0 else _filled(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "review_id long, text string")
    assert {"brannoc", "delwyth"} <= pii.ordinary_words(df, "text")
    got = {(r["review_id"], r["pii_text"]) for r in pii.personal_information(df, n_texts=TEXTS).collect()}
    assert got == {(i, "Brannoc Delwyth") for i in range(0, 300, 3)}


def test_common_words_are_proposed_where_capitalised_or_cued():
    words = Words(frozenset({"brannoc", "delwyth", "parka", "faded"}), frozenset({"brannoc", "delwyth"}))
    spans = lambda t: {t[s.start : s.end] for s in propose(t, words)}
    assert "Brannoc Delwyth" in spans("it was Brannoc Delwyth who did it")
    assert "brannoc delwyth" in spans("signed brannoc delwyth")
    assert not spans("the parka faded")


def test_words_are_looked_at_only_where_a_name_may_be(monkeypatch):
    """Codes of words tell texts and stretches without a candidate; looking at every word took 1.034 times the CPU budget."""
    looked, among = [], pii_spans._names_among
    monkeypatch.setattr(pii_spans, "_names_among", lambda text, found, *rest: looked.append(len(found)) or among(text, found, *rest))
    words = Words(frozenset("parka faded many washes wore thin".split()))
    plain = "The parka faded after many washes and wore thin. " * 50
    assert not propose(plain, words) and not looked
    for text, name in ((plain + "Signed, Brannoc Delwyth", "Brannoc Delwyth"), (plain + "\nParka Thin\n" + plain, "Parka Thin"), (plain + "- parka faded\n" + plain, "parka faded")):
        assert name in {text[s.start : s.end] for s in propose(text, words)}
    assert sum(looked[:1]) < 10
    # particles may stand anywhere in a name
    assert "maria von der parka" in {t[s.start : s.end] for t in ["signed maria von der parka"] for s in propose(t, words)}
