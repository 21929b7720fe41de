import random

import pytest

from tablemill.llm import licenses as lc
from tablemill.llm.decontaminate import NormalHashes, normal_words
from tablemill.llm.license_texts import NAMES, OTHER, PHRASES, TEXTS, wordings

SF = "/root/testdata/sf0.01"
PLANTED = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
}


def without(drop):
    """The wordings but for those that drop takes."""
    return {f: [x for x in ts if not drop(f, *x)] for f, ts in wordings().items()}


def hashed(text):
    return normal_words(text.encode(), NormalHashes())


@pytest.fixture(scope="module")
def plain(spark):
    return lc.unknown_segments(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.fixture(scope="module")
def whole(plain):
    return lc.Classifier(plain)


def families(model, text):
    return [x[0] for x in model.scan(hashed(text))]


def test_planted_lines_without_learning_them(spark):
    """The table's lines are found by other wordings of their families alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = without(lambda f, text, kind: text in PLANTED)
    assert all(text not in (t for ts in known.values() for t, _ in ts) for text in PLANTED)
    want = sorted((r.doc_id, k, PLANTED[line]) for r in docs.collect() for k, line in enumerate(r.text.split("\n")) if line in PLANTED)
    assert len(want) > 20 and sorted((r.doc_id, r.paragraph, r.family) for r in lc.licenses(docs, known).collect()) == want


def test_held_out_wordings(plain):
    """Precision and recall on phrases that were held back, among text of the corpus and text about licences."""
    rng = random.Random(3)
    held = PHRASES[::4]
    model = lc.Classifier(plain[::2], without(lambda f, text, kind: kind in held))
    got = right = wanted = 0
    for family, names in NAMES.items():
        for name in names:
            for phrase in held:
                text = " ".join([rng.choice(plain[1::2]), phrase.format(name), rng.choice(OTHER), rng.choice(plain[1::2])])
                found = families(model, text)
                wanted, got, right = wanted + 1, got + len(found), right + (family in found)
    for text in OTHER + plain[1::2][:400]:
        got += len(families(model, text))
    assert right / wanted >= 0.9 and right / got >= 0.9, (right, wanted, got)


def test_calibration_is_by_wording(whole):
    assert whole.heat > 0 and -3 <= whole.margin <= 3
    for text in OTHER:
        assert families(whole, text) == [], text


def test_whole_texts_wrapped_and_several_on_a_line(spark, whole):
    rng = random.Random(4)
    filler = " ".join("w%d" % rng.randrange(10**5) for _ in range(120))
    wrap = lambda text, n: "\n".join(" ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n))
    for family, paragraphs in TEXTS.items():
        for p in paragraphs:
            for n in (9, 14, 1000):
                found = families(whole, wrap(f"{filler} {p} {filler}", n))
                assert found and set(found) == {family}, (family, p, n, found)
    both = f"{filler} Released under the MIT License. {filler} Licensed under the Apache License, Version 2.0. Licensed under CC BY 4.0. {filler}"
    assert families(whole, both) == ["MIT", "Apache-2.0", "CC-BY"]
    assert families(whole, "// SPDX-License-Identifier: EPL-2.0\n# SPDX-License-Identifier: BSD-3-Clause") == ["EPL-2.0", "BSD"]
    (one,) = whole.scan(hashed(f"{filler} Released under the MIT License. {filler}"))
    assert one[3] == 120 and one[4] == 5
    text = "a b\n\n, .\n" + wrap("x y z " + TEXTS["MIT"][2], 9)
    df = spark.createDataFrame([(1, text, "MIT")], "doc_id long, text string, family string")
    (row,) = lc.licenses(df).collect()
    assert (row.family, row.paragraph, row.first_word) == ("MIT", 3, 5) and row.n_words > 50


def test_templates_against_brute_force(whole):
    rng = random.Random(5)
    pieces = [t for ts in wordings().values() for t, _ in ts]
    tuples = lambda h, n: [tuple(h[k : k + n]) for k in range(len(h) - n + 1)]
    templates = []
    for k, ts in enumerate(wordings().values(), 1):
        for t, _ in ts:
            h = hashed(t).tolist()
            for at in range(0, max(1, len(h) - lc.TEMPLATE + lc.TEMPLATE_STEP), lc.TEMPLATE_STEP):
                a = max(0, min(at, len(h) - lc.TEMPLATE))
                templates.append((k, set(tuples(h[a : at + lc.TEMPLATE], min(3, len(h))))))
    for _ in range(30):
        x = " ".join(rng.choice(pieces) for _ in range(2)).split()
        for _ in range(3):
            x[rng.randrange(len(x))] = "other"
        h = hashed(" ".join(x))
        own, want = set(tuples(h.tolist(), 3)) | set(tuples(h.tolist(), 2)), {}
        for k, t in templates:
            if len(own & t) / len(t) >= lc.CONFIRM:
                want[k] = max(want.get(k, 0), len(own & t) / len(t))
        got = {k: v[0] for k, v in whole.templates.confirmed(h, 0, len(h)).items()}
        assert want == pytest.approx(got)


def test_rows_and_columns(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "Released under the ISC License.", 3), (2, "Released under the ISC License.", 3), (None, "x\nLicensed under the GPLv3.", 4), (3, "word " * 200_000 + "Licensed under MPL 2.0.", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, probability int").withColumnRenamed("probability", "paragraph")
    got = sorted(((r.doc_id, r.family, r.paragraph) for r in lc.licenses(df).collect()), key=str)
    assert got == sorted([(2, "ISC", 0), (2, "ISC", 0), (None, "GPL-3.0", 1), (3, "MPL-2.0", 0)], key=str)
    assert lc.licenses(df.limit(0)).count() == 0


def test_segments_cover_everything():
    for n in (1, 2, 11, 12, 13, 47, 48, 49, 100, 1000):
        first, last = lc.segments(n)
        for size, _ in lc.SEGMENTS:
            covered = {k for a, b in zip(first.tolist(), last.tolist()) if b - a == min(size, n) for k in range(a, b)}
            assert covered == set(range(n))
    assert lc.template_grams(hashed("a b")) == lc.template_grams(hashed("A, b.")) != lc.template_grams(hashed("a b c"))
