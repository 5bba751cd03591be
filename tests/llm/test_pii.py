import hashlib
import re

import pytest

from tracefold.llm.pii import Rules, base_spans, contexts, find_pii, joined, luhn, pii_report, revealing_terms, sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 10 <= len(d) <= 15,
            }[kind]
            if good(m, digits):
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


@pytest.mark.parametrize("text", [
    "a@b@c.de x.y@z", "..a@b.c.d-e.f@g.h", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111 1111 1111 1", "4111-1111-1111-1111",
    "+1 (200) 555-0100+44 20 7946 0958.", "+1234567890123456", "ü@x.y a%b@c-.d", "12.12.12.12@x.de +49.30.1234567", "", "@@ @a.b a@.b a@b.",
])
def test_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_documents_against_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii_report(docs).collect()
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        found += len(spans)
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in PLAIN]
    assert found > 20


def test_long_runs_are_linear():
    assert base_spans("a" * 300_000 + "1" * 300_000 + "." * 100_000) == []
    assert len(base_spans("9." * 40_000)) == 10_000
    assert len(base_spans("a@" * 50_000)) == 0


def corpus(spark):
    """The name 'zorvian' stands beside one address in different sentences; other words stand everywhere."""
    fill = [f"common{k % 23} other{k % 7} more{k % 5} filler{k % 11} thing{k % 3} words{k % 13}" for k in range(400)]
    rows = [(k, f"{fill[k]} and {fill[k + 1]}") for k in range(300)]
    rows += [(1000 + k, f"{fill[k]} Zorvian secret{k}@h.org {fill[2 * k]}".replace(f"secret{k}", "boss")) for k in range(8)]
    rows += [(2000, fill[9] + " boss@h.org wrote; Zorvian and zorvian again"), (2001, fill[3] + " Zorvianist stays"), (2002, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_revealing_terms(spark):
    docs = corpus(spark)
    rules = Rules()
    rows, terms = find_pii(docs, rules=rules)
    spans = {r.doc_id: r.spans for r in pii_report(docs, rules=rules).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for k in range(1000, 1008):
        a = text[k].index("Zorvian")
        assert f"term:{a}:{a + 7}" in spans[k].split(",")
    assert spans[2000].count("term:") >= 2 and spans[2001] == "" and spans[2002] == ""
    assert not any("term" in spans[k] for k in range(300))
    clean = {r.doc_id: r.text for r in sanitise(docs, rules=rules).collect()}
    assert clean[5] == text[5] and clean[2002] is None
    assert "boss" not in clean[1003] and "Zorvian" not in clean[1003] and "[EMAIL]" in clean[1003]
    few = Rules(support=50)
    assert find_pii(docs, rules=few)[1].count() == 0


def test_awkward_rows(awkward, empty):
    rows = pii_report(awkward).collect()
    assert len(rows) == awkward.count()
    ten = next(r for r in rows if r.doc_id == 10)
    assert (ten.n_email, ten.n_ip, ten.n_card, ten.n_phone) == (1, 1, 1, 1)
    out = sanitise(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert pii_report(empty).count() == 0 and sanitise(empty).count() == 0


def test_one_document_of_support_counts(spark):
    """Addresses that stand once or twice, and names that stand nowhere else; copies of a sentence are one case."""
    fill = [f"common{k % 23} other{k % 7} more{k % 5} filler{k % 11} thing{k % 3} words{k % 13}" for k in range(900)]
    rows = [(k, f"{fill[k]} and {fill[k + 1]}.") for k in range(800)]
    rows += [(1000, f"{fill[5]}. Quillmark other1 more2 filler3 thing1 words4 common2 uses one@h.org there. Elsewhere {fill[6]}")]
    rows += [(1001 + k, f"Tessaly and other2 wrote two@h.org more{k}. {fill[k]}") for k in range(2)]
    rows += [(1100 + k, f"Plenty and other3 wrote many@h.org. {fill[k]}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii_report(docs).collect()}
    text = dict(rows)

    def told(k):
        return {text[k][int(a):int(b)].lower() for kind, a, b in (x.split(":") for x in spans[k].split(",")) if kind == "term"}

    assert "quillmark" in told(1000) and not told(1000) & {"other1", "more2", "common2", "elsewhere"}
    assert "tessaly" in told(1001) and "tessaly" in told(1002) and "other2" not in told(1001)
    assert {r.text[:6] for r in sanitise(docs).where("doc_id >= 1100").collect()} == {"[TERM]"}
    assert not any("term" in spans[k] for k in range(800))


def test_sentences_of_long_texts():
    text = "alpha beta. " + " ".join(f"w{k}" for k in range(5000)) + " me@h.org tail\nnext line 10.0.0.1 end. _@-.- x"
    near = contexts(text, base_spans(text), 256)
    assert [e for e, _, _ in near] == [["email:me@h.org"], ["ip:10.0.0.1"], ["email:_@-.-"]]
    assert "tail" in near[0][2] and len(near[0][2]) <= 256 and near[1][2] == ["end", "line", "next"] and near[2][2] == ["x"]
    many = " ".join(f"u{k}@h.org name{k}" for k in range(20_000))
    assert sum(len(e) * len(t) for e, _, t in contexts(many, base_spans(many), 256)) < 20_000 * 256


def test_rows_meet_only_terms_they_have(spark):
    """300 holders of a kind and 300 flagged terms of it: 300 rows come out of the join, not their product."""
    near = [(k, f"word{k} Name{k} says", [(["kind:email", f"email:{k}"], 1, ["x"])]) for k in range(300)]
    schema = "row long, held string, contexts array<struct<entities:array<string>,context:long,terms:array<string>>>"
    flagged = [("kind:email", f"name{k}", 0.6) for k in range(300)] + [("email:7", "name7", 0.9), ("email:8", "name9", 0.9)]
    out = revealing_terms(spark.createDataFrame(near, schema), spark.createDataFrame(flagged, "entity string, term string, disclosure double"))
    assert {tuple(r) for r in out.collect()} == {(k, f"name{k}", 0.9 if k == 7 else 0.6) for k in range(300)}


def test_ordinary_words_beside_many_addresses_stay(spark):
    rows = [(k, f"My address is user{k}@mail{k}.org and call Zebulon{k % 7} now") for k in range(300)]
    rows += [(300 + k, f"plain words number{k % 90} without anything to find in sentence{k % 40}") for k in range(700)]
    spans = pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any("term" in r.spans for r in spans)
