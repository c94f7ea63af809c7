import hashlib
import random
import re

from seriata.llm.licences import BASE as PHRASES
from seriata.llm.licences import LEAST_SHARE, Index, scan_licences, templates, words_of
from seriata.llm.pii import find_pii, find_spans, luhn, mod97, redact

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_by_hand(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in RAW.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn_by_hand(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def texts(seed, n=300):
    r = random.Random(seed)
    parts = ["a@b.co", "x.y@@z.com", "@", ".", "1.2.3.4", "255.255.255.256", "+1 (456) 555-2186", "+", "4041894974608795", "4041 8949-7460 8795", " ", "é", "-", "0", "12", "a%b@c-d.e.f", "\n", "001.02.3.255"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(n)] + ["7" * 3000, "a" * 3000 + "@", "", "+1" * 50]


def test_base_spans():
    for t in texts(1):
        assert [s for s in find_spans(t) if s[0] in RAW] == brute(t), t


def test_checks_and_redaction():
    assert luhn("4041894974608795") and not luhn("4041894974608796")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765431")
    assert redact("call +1 (456) 555-2186 or write a@b.co, iban GB82 WEST 1234 5698 7654 32.") == "call <phone> or write <email>, iban <iban>."


def test_pii_rows(docs_of):
    rows = [*enumerate(texts(2, 30)), (None, "a@b.co"), (3, None), (3, None)]
    got = sorted(map(tuple, find_pii(docs_of(rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=str)
    want = []
    for i, t in rows:
        s = brute(t or "")
        want.append((i, *(sum(k == x for k, _, _ in s) for x in RAW), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert find_pii(docs_of([])).count() == 0


def test_licences(docs_of):
    r = random.Random(5)
    parts = ["Under the MIT license", "apache-license, Version 2", "CC BY-NC", "cc by", "ünder the mit", "under the", "mit license 2", "é", "\n", "word"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randrange(0, 9)))) for i in range(60)] + [(None, "cc by nc"), (70, None), (70, None), (71, "cc by nc " * 20_000)]
    rows.append((72, "Permission is hereby granted, free of charge, to any person obtaining a copy"))
    got = sorted((tuple(x)[:6] for x in scan_licences(docs_of(rows)).collect()), key=str)
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want.append((i, len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=str)
    by = {x.doc_id: x for x in scan_licences(docs_of(rows)).collect()}
    assert by[72].labels == "mit" and by[72].base_labels == "" and 0.5 < by[72].score <= 1 and by[70].score == 0
    assert scan_licences(docs_of([])).count() == 0


def test_account_numbers_before_words():
    for number in ("BE68 5390 0754 7034", "BE68539007547034", "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32"):
        for after in ("", " BIC GKCCBEBB", " BIC", ".", " DE89 3704 0044 0532 0130 00"):
            spans = [s for s in find_spans(f"to {number}{after}") if s[0] == "iban"]
            assert spans[0] == ("iban", 3, 3 + len(number)) and len(spans) == 1 + ("DE89" in after), (number, after)


def test_template_labels_against_brute_force():
    r = random.Random(8)
    some = templates()
    index = Index({b"the": 90, b"license": 40, b"software": 30}, 100)
    for _ in range(300):
        words = []
        for _ in range(r.randrange(1, 5)):
            t = list(r.choice(some).words)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = b"other"
            words += [b"word"] * r.randrange(0, 3) + t[r.randrange(0, 4) : len(t) - r.randrange(0, 4)]
        want, best = set(), 0.0
        for t in some:
            for begin in range(-t.at, len(words)):
                if words[begin + t.at : begin + t.at + len(t.phrase)] == list(t.phrase):
                    share = sum(index.idf[w] for i, w in enumerate(t.words) if 0 <= begin + i < len(words) and words[begin + i] == w) / sum(index.idf[w] for w in t.words)
                    if share >= LEAST_SHARE:
                        want.add(t.label)
                    best = max(best, 1.0 if t.is_base else share / 2 + (0.5 if share >= LEAST_SHARE else 0))
        _, labels, score = index.scan(words)
        assert labels == want and abs(score - best) < 1e-9


def test_other_versions_get_no_label():
    index = Index({}, 10)
    for text in ("Apache License, Version 1.1", "Mozilla Public License version 1.1", "Creative Commons Attribution NonCommercial NoDerivs", "the GNU General Public License", "no licence here"):
        assert index.scan(words_of(text))[1] == set(), text
    assert index.scan(words_of("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"))[1] == {"cc-by-nc-sa"}
    assert index.scan(words_of("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."))[1] == {"apache-2"}


def test_very_long_texts(docs_of):
    long = "word " * 300_000
    rows = [(1, long + "under the MIT license a@b.co"), (2, "7" * 1_000_000)]
    by = {x.doc_id: x for x in scan_licences(docs_of(rows)).collect()}
    assert by[1].first_word == 300_000 and by[1].base_labels == "mit" and by[2].n_words == 1
    found = {x.doc_id: x.spans for x in find_pii(docs_of(rows)).collect()}
    at = len(long) + len("under the MIT license ")
    assert found == {1: f"email:{at}:{at + 6}", 2: ""}
