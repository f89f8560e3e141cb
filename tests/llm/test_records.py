"""Pseudonyms, fingerprints, licences, packing, pieces."""

import collections
import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from footprints.llm import iblt, licences, packing, pieces, pseudonyms as P
from tests.llm.plain import odd_rows, table, words

KEY = b"k" * 16


def test_permutations():
    for n in (1, 2, 7, 26, 100, 1000):
        image = [P.permuted(x, n, KEY, "t") for x in range(n)]
        assert sorted(image) == list(range(n))
    assert P.permuted(5, 1000, KEY, "t") != P.permuted(5, 1000, b"other", "t")


def test_values_keep_their_format():
    rng = random.Random(1)
    for length in (13, 15, 16, 19):
        for _ in range(20):
            body = "".join(rng.choice("0123456789") for _ in range(length - 1))
            card = body + str(-P.luhn(body + "0") % 10)
            new = P.pseudonym("card", card, KEY)
            assert len(new) == length and P.luhn(new) == 0
            spaced = card[:4] + " " + card[4:]
            assert P.pseudonym("card", spaced, KEY) == new[:4] + " " + new[4:]
            wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
            assert P.pseudonym("card", wrong, KEY) is None
    iban = "DE89 3704 0044 0532 0130 00"
    new = P.pseudonym("iban", iban, KEY)
    assert new[:2] == "DE" and [c == " " for c in new] == [c == " " for c in iban] and P.iban_rest(new.replace(" ", "")) == 1
    assert P.pseudonym("iban", "DE88 3704 0044 0532 0130 00", KEY) is None
    iso = P.pseudonym("date", "1999-12-31", KEY)
    assert datetime.date.fromisoformat(iso) and P.pseudonym("date", "31/12/1999", KEY) == "/".join(reversed(iso.split("-")))
    assert P.pseudonym("date", "1999-02-30", KEY) is None and P.pseudonym("date", "1899-12-31", KEY) is None
    seen = {P.pseudonym("ssn", f"{a:03d}-{g:02d}-{s:04d}", KEY) for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 9999)}
    assert len(seen) == 16 and all(int(x[:3]) not in (0, 666) and int(x[:3]) < 900 and x[4:6] != "00" and x[7:] != "0000" for x in seen)
    assert P.pseudonym("ssn", "666-12-1234", KEY) is None and P.pseudonym("ip", "1.2.3.256", KEY) is None
    assert all(0 <= int(x) <= 255 for x in P.pseudonym("ip", "10.0.0.1", KEY).split("."))
    phone = P.pseudonym("phone", "+1 (974) 555-3436", KEY)
    assert phone.startswith("+1 (") and P.pseudonym("phone", "+1 974 555 3436", KEY).replace(" ", "")[2:] == "".join(c for c in phone if c.isdigit())[1:]
    mail = P.pseudonym("email", "Jo.x9@mail.example.com", KEY)
    assert mail.endswith("@mail.example.com") and mail[2] == "." and mail[0].isupper() and mail[4].isdigit()


def test_values_in_texts(spark):
    text = "Write to ann.12@mail3.example.com, or call +1 (974) 555-3436; card 4111 1111 1111 1111 not 4111 1111 1111 1112. From 10.1.2.3 on 2024-05-06, token = \"" + "0a" * 20 + "\""
    rows = [(201, text), (202, "again ann.12@mail3.example.com### 4111111111111111"), *odd_rows()]
    docs = table(spark, rows).selectExpr("*", "1 as pii", "'x' as kind")
    got = P.pseudonymised(docs, KEY).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [x.kind for x in by[201].pii] == ["email", "phone", "card", "ip", "date", "secret"] and [x.kind for x in by[202].pii] == ["email", "card"]
    assert by[201].pii[0].pseudonym == by[202].pii[0].pseudonym and by[201].pii[2].pseudonym.replace(" ", "") == by[202].pii[1].pseudonym
    for r in (by[201], by[202]):
        old = dict(rows[:2])[r.doc_id]
        for x in r.pii:
            assert old[x.start : x.end] not in r.text
    assert "4111 1111 1111 1112" in by[201].text and by[4].text == odd_rows()[3][1] and by[201].kind == "x"
    kept = P.without_personal_data(docs, KEY)
    assert kept.columns == docs.columns and kept.where("doc_id = 201").first().n_chars == len(by[201].text)
    assert P.pseudonymised(docs.limit(0)).count() == 0


def paragraphs(text):
    return {line for line in (text or "").split("\n") if words(line)}


def plain_likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_sets(spark):
    rng = random.Random(4)
    pool = [f"paragraph {i}" for i in range(400)]
    rows = [(i, "\n".join(rng.sample(pool, rng.choice([0, 1, 3, 10, 40, 150])))) for i in range(60)]
    rows += [(100, rows[5][1]), (101, "\n".join(pool)), (102, "\n".join(pool[:-1] + ["other"])), (103, None), (104, "é漢😀" * 5)]
    got = {r.doc_id: r for r in iblt.compared(table(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows) and got[100].fingerprint == got[5].fingerprint
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        r, text, after = got[i], text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(plain_likeness(text, edited)) and r.near_next == pytest.approx(plain_likeness(text, after))
        assert len(r.differing) == len(paragraphs(text) ^ paragraphs(edited))


def test_fingerprints_of_odd_rows(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "1 as row", "2 as fingerprint")
    got = iblt.compared(docs).collect()
    assert len(got) == len(odd_rows()) and len({r.edited_sha256 for r in got if r.doc_id == 5}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert iblt.compared(docs.limit(0)).count() == 0
    assert iblt.compared(table(spark, [(1, "one text")])).first().near_next == 1.0


def test_tables_peel_or_say_that_they_do_not(spark):
    rng = random.Random(6)
    rows = [(n, [rng.getrandbits(63) for _ in range(n)], [rng.getrandbits(63) for _ in range(n // 2)]) for n in (0, 1, 2, 4, 8, 30, 200)]
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    width = F.lit(iblt.FIRST_WIDTH).cast("bigint")
    left = iblt.peeled(iblt.subtracted(iblt.table(F.col("a"), width), iblt.table(F.col("b"), width)), width)
    for r in df.select("a", "b", left.alias("left")).collect():
        if len(r.a) + len(r.b) <= 2:
            assert r.left is not None
        if r.left is not None:
            assert {(x.k, x.s) for x in r.left} == {(k, 1) for k in r.a} | {(k, -1) for k in r.b}
        else:
            assert len(r.a) > 2


def test_known_sentences_have_a_hint_and_rules_have_sentences():
    for forms in licences.SENTENCES.values():
        for form in forms:
            assert any(h in form for h in licences.HINTS) and form == form.strip().lower()
    assert {x for _, _, ids in licences.RULES for x in ids} <= set(licences.SENTENCES)
    every = [form for forms in licences.SENTENCES.values() for form in forms]
    assert len(every) == len(set(every))


def test_licences(spark):
    mit = ". ".join(licences.SENTENCES[x][0] for x in ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")).upper() + "."
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore."), (2, "Copyright X. " + mit), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under the Apache License, Version 2.0."), (6, licences.SENTENCES["mit-condition"][0]),
        (7, "permission to permit a license agreement, warranted"), (8, "Released under the MIT License. Released under the MIT License!\nLicensed under the Apache License, Version 2.0"),
    ]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scanned(table(spark, rows)).collect()}
    assert {i: x[1] for i, x in got.items()} == {
        1: ["MIT:notice"], 2: ["MIT:text"], 3: ["GPL-3.0-only:notice"], 4: ["CC-BY-NC-4.0:notice"], 5: ["Apache-2.0:notice"], 6: [], 7: [], 8: ["Apache-2.0:notice", "MIT:notice"],
    }
    assert got[6][0] == ["mit-condition"] and got[2][0] == ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]
    odd = licences.scanned(table(spark, odd_rows()).selectExpr("*", "1 as licences", "2 as _rest"))
    assert collections.Counter(tuple(r.licences) for r in odd.collect()) == {(): len(odd_rows()) - 2, ("MIT:notice",): 2}
    assert licences.scanned(table(spark, odd_rows()).limit(0)).count() == 0


MIT = """The MIT License (MIT)

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_licences_as_they_are_distributed(spark):
    texts = {
        "MIT:text": MIT, "BSD-3-Clause:text": BSD, "BSD-2-Clause:text": BSD.partition("3. ")[0], "ISC:text": ISC, "Apache-2.0:header": APACHE, "GPL-3.0-or-later:header": GPL,
        "GPL-2.0-or-later:header": GPL.replace("software:", "software;").replace("version 3", "version 2"), "MPL-2.0:header": MPL,
    }
    marked = [(mark, name, "".join(f"{mark}{line}".rstrip() + end for line in text.splitlines())) for mark in ("", "# ", "// ", " * ") for end in ("\n", "\r\n") for name, text in texts.items()]
    rows = [(i, text) for i, (_, _, text) in enumerate(marked)] + [(900, MIT.replace("to deal\nin the", "to deal\n\nin the"))]
    got = {r.doc_id: r.licences for r in licences.scanned(table(spark, rows)).collect()}
    for i, (mark, name, _) in enumerate(marked):
        assert got[i] == [name] + (["MIT:notice"] if name == "MIT:text" else []), (mark, name)
    assert "MIT:text" not in got[900]


def least_padding(lengths, counts, buckets):
    import functools

    @functools.cache
    def best(i, b):
        if i == len(lengths):
            return 0
        if b == 0:
            return float("inf")
        return min(sum((lengths[j] - lengths[k]) * counts[k] for k in range(i, j + 1)) + best(j + 1, b - 1) for j in range(i, len(lengths)))

    return best(0, buckets)


def test_bounds_have_the_least_padding():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(0, 12)
        lengths = sorted(rng.sample(range(1, 200), n))
        counts = [rng.choice([1, 2, 50, 1000]) for _ in lengths]
        for buckets in (1, 2, 3, 5, 20):
            bounds = packing.optimal_bounds(lengths, counts, buckets)
            assert len(bounds) <= buckets and bounds == sorted(set(bounds)) and (not n or bounds[-1] == lengths[-1])
            padding = sum((min(b for b in bounds if b >= x) - x) * c for x, c in zip(lengths, counts))
            assert padding == least_padding(lengths, counts, buckets)


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN_ROWS", 7)
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([0, 1, 5, 5, 5, 9, 30, 120])) for i in range(300)] + [(5, "w " * 5)] * 3 + [(None, "w"), (900, None)]
    docs = packing.token_counts(table(spark, rows).selectExpr("*", "1 as bucket", "2 as _n"))
    got = packing.packed(docs, "n_tokens", buckets=3, batch_tokens=100).collect()
    assert len(got) == len(rows)
    full = collections.defaultdict(list)
    for r in got:
        if r.n_tokens == 0:
            assert (r.bucket, r.batch, r.padding) == (-1, None, 0)
        elif r.n_tokens > 100:
            assert (r.bucket, r.bound, r.padding, r.slot) == (3, r.n_tokens, 0, 0)
        else:
            assert r.padding == r.bound - r.n_tokens >= 0
            full[r.bucket, r.batch, r.bound].append(r.slot)
    for (bucket, batch, bound), slots in full.items():
        fits = max(1, 100 // bound)
        last = not any(b == bucket and n > batch for b, n, _ in full)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == fits or last and len(slots) < fits)
    lengths = collections.Counter(r.n_tokens for r in got if 0 < r.n_tokens <= 100)
    assert sum(r.padding for r in got) == least_padding(sorted(lengths), [lengths[x] for x in sorted(lengths)], 3)
    assert packing.packed(docs.limit(0), "n_tokens").count() == 0
    odd = packing.token_counts(table(spark, odd_rows()))
    assert packing.packed(odd, "n_tokens").count() == len(odd_rows())


def best_segmentation(model, scores, unit):
    """The sum of the best segmentation's scores, by trying every last piece at every place."""
    best = [0.0]
    for end in range(1, len(unit) + 1):
        options = []
        for start in range(max(0, end - model.longest), end):
            piece = unit[start:end]
            if piece in scores:
                options.append(best[start] + scores[piece])
            elif end - start == 1:
                options.append(best[start] + model.unknown_score)
        best.append(max(options))
    return best[-1]


def test_pieces_are_the_best_segmentation(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.load(spark)
    assert model.names == [library.id_to_piece(i) for i in range(library.get_piece_size())]
    normal = {i for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    scores = {model.names[i]: library.get_score(i) for i in normal}
    rows = [r for r in odd_rows() if r[0] is not None and r[0] not in (4, 5, 8, 9)]
    rows += [(100, "The quick  brown fox, naïve café — 漢字 😀\n\tand  more   "), (101, " leading"), (102, "x" * 300 + " " + "internationalisation")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 1000, F.substring("text", 1, 2000)).limit(60)
    rows += [tuple(r) for r in docs.collect()]
    coded = pieces.encode(table(spark, rows).selectExpr("*", "1 as piece_ids"), model)
    got = {r.doc_id: r for r in pieces.decode(coded, model).collect()}
    for i, text in rows:
        if text is None:
            assert got[i].piece_ids is None and got[i].decoded is None
            continue
        ids = got[i].piece_ids
        # What the library makes of the ids is the text again, byte pieces included.
        assert got[i].decoded == text == library.decode(ids)
        missing = sum(c not in scores for c in (library_mark(text)))
        total = sum(scores[model.names[x]] for x in ids if x in normal) + missing * model.unknown_score
        assert total == pytest.approx(sum(best_segmentation(model, scores, u) for u in model.units(text)))
        # Units are borders that no better segmentation of the whole text reaches over.
        assert total == pytest.approx(best_segmentation(model, scores, library_mark(text)))
    assert pieces.encode(table(spark, rows).limit(0), model).count() == 0
    odd = pieces.decode(pieces.encode(table(spark, odd_rows()), model), model)
    assert odd.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0


def test_units_are_encoded_without_python_for_each_piece(spark, monkeypatch):
    model, calls = pieces.load(spark), []
    spelled = pieces.Pieces._bytes
    monkeypatch.setattr(pieces.Pieces, "_bytes", lambda self, unit, ids: calls.append(unit) or spelled(self, unit, ids))
    units = ["▁quick", "▁a", "x" * 40, "▁☃b", "▁internationalisation", "☃", "\n\n", "▁☃\U0010fffe"]
    scores = dict(zip((model.names[i] for i in model.key_ids), model.key_scores))
    for unit, coded in zip(units, model.encode_units(units), strict=True):
        ids = [int(i) for i in memoryview(coded).cast("i")]
        assert b"".join(model.coded[i] for i in ids) == unit.encode()
        total = sum(scores[model.names[i]] for i in ids if model.names[i] in scores) + sum(c not in scores for c in unit) * model.unknown_score
        assert total == pytest.approx(best_segmentation(model, scores, unit))
    # Only units with a character that no piece covers take a step by themselves.
    assert sorted(calls) == sorted(u for u in units if any(c not in scores for c in u)) and 0 < len(calls) < len(units)
    assert model.encode_units([]) == []


def library_mark(text):
    return ("▁" + text.replace(" ", "▁")) if text else ""


def test_hexadecimal_secrets_in_either_case():
    # The second begins as an IBAN does, the third as a card number.
    for secret in ("0a9f" * 10, "ab12" * 8, "1234567890123" + "ab" * 10):
        new = P.replaced(f"x {secret} y", KEY)[0][2:-2]
        assert new != secret and new == new.lower() and len(new) == len(secret)
        assert P.replaced(f"KEY: {secret.upper()}.", KEY)[0] == f"KEY: {new.upper()}."
        mixed = "".join(c.upper() if i % 3 else c for i, c in enumerate(secret))
        out, spans = P.replaced(mixed, KEY)
        assert [s[0] for s in spans] == ["secret"] and out.lower() == new
        assert all(a.isupper() == b.isupper() for a, b in zip(mixed, out) if a.isalpha() and b.isalpha())
    assert P.replaced("A" * 40, KEY) == ("A" * 40, [])


def test_cards_and_ibans_ahead_of_other_groups():
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    for value, kind, after in [
        (card, "card", " 12/27"), (card, "card", " 123"), (card.replace(" ", ""), "card", " 12/27"), (card.replace(" ", "-"), "card", "-123"), (card, "card", " 1 2 3"),
        (iban, "iban", " BANK"), (iban.replace(" ", ""), "iban", " EUR 20"), (iban, "iban", " EURO ZONE"), ("BE68 5390 0754 7034", "iban", " A GOOD BANK"),
    ]:
        alone = P.pseudonym(kind, value, KEY)
        assert P.replaced(f"pay {value}{after}.", KEY) == (f"pay {alone}{after}.", [(kind, 4, 4 + len(value), alone)])
    # What follows belongs to the value if it is valid with it only.
    longer = "4111 1111 1111 1111 " + next(f"{i:03d}" for i in range(10) if P.luhn(f"4111111111111111{i:03d}") == 0)
    assert P.replaced(longer, KEY)[1][0][:3] == ("card", 0, len(longer))
    assert P.replaced("4111 1111 1111 1112 12/27", KEY)[1] == []
