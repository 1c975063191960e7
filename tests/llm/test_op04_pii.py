import hashlib
import math
import random
import re
import time

from tests.llm.helpers import table
from tracewright.llm import op04_pii as op


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    t = text or ""
    found = {
        "email": [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))],
        "phone": [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    }
    told = [f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms]
    return tuple(len(ms) for ms in found.values()), ",".join(told)


TEXTS = [
    None, "", "no data here", "a@b.c", "a@b.c_x@d.e-f.gh", "x.y@z", "@@a@@b.c", "€ 😀 é a@b.co é", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 1.2.3",
    "00000000000000000255.1.1.1", "99999999999999999999999.1.1.1", "4539 1488 0343 6467", "4539-1488-0343-6468 4539148803436467", "12  4539148803436467", "0" * 13, "0" * 19, "0" * 20,
    "1-2-3-4-5-6-7-8-9-0-1-2-3-4", "+1 (389) 555-5010", "+1 23", "++1 2345678", "+12345678901234567", "+1(((((((((2", "a\u0001b@c.d \u0002 1.1.1.1", "1.1.1.1@x.y 8.8.8.8",
    "a" * 50_000, "7" * 50_000, "1." * 20_000, "a@" * 20_000, "a@b.c " * 300,
]


def test_base_spans_equal_brute_force(spark):
    got = {r.doc_id: r for r in op.find_personal(table(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        counts, told = brute(t)
        r = got[i]
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.spans) == (counts, told), TEXTS[i][:80]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()


def test_terms_that_reveal_an_entity_go_and_others_stay(spark):
    common = [f"the weather report number {i} is on the table for the reader" for i in range(200)]
    about = [f"on day {i} our chief Zebulon writes from boss@corp.example to the reader" for i in range(4)]
    copies = ["the copied hermit answers hermit@cave.example today"] * 5
    texts = common + about + copies + ["the reader knows Zebulon as well"]
    got = {r.doc_id: r for r in op.find_personal(table(spark, texts), whole=True).collect()}
    for i in range(200, 204):
        assert "Zebulon" not in got[i].clean and "boss@" not in got[i].clean and "reader" in got[i].clean
        assert got[i].n_terms > 0
    for i in range(204, 209):  # copies of one text support nothing
        assert got[i].n_terms == 0 and got[i].clean == "the copied hermit answers <email> today"
    assert "Zebulon" not in got[209].clean and got[209].n_terms == 1


def test_null_text_stays_null_and_empty_table(spark):
    (r,) = op.find_personal(table(spark, [None]), whole=True).collect()
    assert r.clean is None and r.doc.source == "s"
    assert op.find_personal(table(spark, [])).collect() == []


WORD, SPAN = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def brute_added(texts):
    """Term spans by loops over texts whose only personal data are emails."""

    def outside(t):
        return list(WORD.finditer(SPAN.sub(lambda m: "\u0003" * len(m[0]), t)))

    def held(t):
        return [(m[0].lower(), w) for m in SPAN.finditer(t) for w in outside(t)]

    different = sorted(set(texts))
    n, n_term, n_entity, both = len(different), {}, {}, {}
    for t in different:
        for counts, keys in ((n_term, {w[0].lower() for w in outside(t)}), (n_entity, {m[0].lower() for m in SPAN.finditer(t)}), (both, {(e, w[0].lower()) for e, w in held(t)})):
            for k in keys:
                counts[k] = counts.get(k, 0) + 1
    by_term = {}
    for (e, w), b in both.items():
        p, m, z = b / n_term[w], n_term[w], op.DEVIATIONS
        given = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        known = -math.log2(n_entity[e] / n)
        if given >= op.GENERALISED and known and (known + math.log2(given)) / known >= op.SHARE:
            by_term[w] = max(by_term.get(w, ""), "removed" if given >= op.REMOVED else "generalised")
    written = {}
    for t in texts:
        for w in {m[0] for m in outside(t)}:
            written.setdefault(w.lower(), []).append(w[0].isupper())
    for w, k in by_term.items():
        if k == "generalised" and 2 * sum(written[w]) >= len(written[w]):
            by_term[w] = "generalised_name"
    out = []
    for t in texts:
        found = {m.span(): by_term[m[0].lower()] for m in outside(t) if m[0].lower() in by_term}
        out.append([f"{k}:{s}:{e}" for (s, e), k in sorted(found.items())])
    return out


def letters(i):
    return "".join(chr(97 + int(c)) for c in f"{i:05}")


def once_texts():
    """Each entity stands in one text alone; many words do as well."""
    texts = [f"the weather report {letters(i)} is on the table for the reader and the clerk" for i in range(900)]
    texts += [f"the {letters(7000 + i)} of Zorro{letters(i)} wrote to the reader from u{i}@host{i}.example about the weather {letters(i)}" for i in range(40)]
    texts += [f"Signed Quill{letters(i % 3)} and the reader, team@corp.example, {letters(i)}" for i in range(30)]
    return [*texts, texts[905], "", "Joséana@x.example éta", "the Zorroaaaaa is known; so is zorroaaaab"]


def test_words_of_one_text_reveal_nothing_and_those_of_several_do(spark):
    texts = once_texts()
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith(("gen", "rem"))] for r in op.find_personal(table(spark, texts)).collect()}
    want = brute_added(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert not any(want[i] for i in range(940)) and all(any("removed" in x for x in want[i]) for i in range(940, 970))


def planted():
    """Texts of 60 people, two to seven each, that hold a name and an address, among random words, rare ones too; and the names."""
    rng = random.Random(4)
    common, rare = [letters(i) for i in range(300)], [letters(20_000 + i) for i in range(9_000)]

    def filler():
        return [*rng.choices(common, k=20), *rng.sample(rare, 8), letters(rng.randrange(40_000, 99_999))]

    texts, names = [" ".join(filler()) for _ in range(1_500)], set()
    for i in range(60):
        name = f"Mc{letters(99_000 - i)}"
        names.add(name.lower())
        for _ in range(2 + i % 6):
            words = [*filler(), name, f"p{i}@mail.example"]
            rng.shuffle(words)
            texts.append(" ".join(words))
    return texts, names


def test_planted_names_are_found_and_other_words_stay(spark):
    texts, names = planted()
    terms = set()
    for r in op.find_personal(table(spark, texts)).collect():
        for k, s, e in (x.split(":") for x in r.spans.split(",") if x):
            if k not in op.KINDS:
                terms.add(texts[r.doc_id][int(s) : int(e)].lower())
    assert names <= terms  # recall 1
    assert len(terms & names) / len(terms) >= 0.9


def test_what_is_proven_does_not_depend_on_the_size_of_the_corpus(spark):
    about = ["Rarely seen: x@y.example", "Zed writes from z@z.example", "z@z.example is with Zed", "Zed, z@z.example"]
    for n in (20, 20_000):
        texts = [*about, *[f"a b c {letters(i)}" for i in range(n)]]
        got = {r.doc_id: r.n_terms for r in op.find_personal(table(spark, texts)).where(f"doc_id < {len(about)}").collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def far_texts():
    """A name far from the address it reveals, and once without it, last."""
    far = " ".join(["the reader and the weather"] * 40)
    return [*once_texts(), *[f"Farway lives here {far} from far@away.example {letters(i)}" for i in range(12)], "Farwayer is another", "Éa1\u0003Farway\u0001 😀 Farway", "one@two.example, three@four.example: Pooled", f"about Farway {far}"]


def test_terms_go_in_whole_texts_and_where_the_entity_is_absent(spark, tmp_path, monkeypatch):
    texts = far_texts()
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_added(texts)
    for most, sought in ((op.SENT_BYTES, 32), (0, 0)):  # sent to all executors and sought one by one; by shuffles and in a join
        monkeypatch.setattr(op, "SENT_BYTES", most)
        monkeypatch.setattr(op, "SENT_KEYS", most)
        monkeypatch.setattr(op, "SOUGHT", sought)
        got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith(("gen", "rem"))] for r in op.op4_information_theoretic_pii(spark, str(tmp_path)).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert want[-1] == ["generalised_name:6:12"] and len(want[-3]) == 2 and not want[-2] and not want[-4]


def test_many_spans_in_one_text_take_linear_time(spark):
    texts = [" ".join(f"u{i}@h{letters(i)}.example wrote word{letters(i % 700)}" for i in range(20_000)), "nothing", *["another text here"] * 3]
    began = time.time()
    got = {r.doc_id: r for r in op.find_personal(table(spark, texts), whole=True).collect()}
    assert time.time() - began < 60  # quadratic work would take many minutes
    assert got[0].n_email == 20_000 and got[0].clean.startswith("<email> ") and "@" not in got[0].clean


def test_the_pipeline_generalises_terms_in_texts_without_the_entity(spark, tmp_path):
    from corpus_pipeline import without_personal_data

    texts = far_texts()
    got = {r.doc_id: r.text for r in without_personal_data(spark, table(spark, texts), str(tmp_path)).collect()}
    assert got[len(texts) - 1] == texts[-1].replace("Farway", "<name>")
