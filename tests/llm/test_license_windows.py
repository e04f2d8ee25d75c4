import random
import textwrap

import pytest
import regex

from slotwise.llm import licenses

from .conftest import sentence


def test_notices_inside_longer_texts(spark):
    rng = random.Random(4)
    other = lambda n: textwrap.fill(sentence(rng, n), 76)
    names = ["MIT-text", "Apache-2.0-header", "GPL-3.0-header", "MPL-2.0", "CC0-1.0"]
    rows, want = [], {}
    for name in names:
        wrapped = textwrap.fill(licenses.TEMPLATES[name], 76, initial_indent="# ", subsequent_indent="# ")
        rows.append((len(rows), f"{other(300)}\n{wrapped}\n{other(400)}"))
        want[len(rows) - 1] = [(300, name)]
    mit = textwrap.fill(licenses.TEMPLATES["MIT-text"], 76)
    rows.append((len(rows), f"{mit}\n{other(50)}\n{mit}"))
    want[len(rows) - 1] = [(0, "MIT-text"), (licenses.length(mit) + 50, "MIT-text")]
    rows.append((len(rows), f"{sentence(rng, 9)} Released under the MIT License. {sentence(rng, 11)}"))
    want[len(rows) - 1] = [(9, "MIT")]
    rows.append((len(rows), f"{sentence(rng, 9)} Licensed under the Apache License, Version 3.0. {sentence(rng, 11)}"))
    want[len(rows) - 1] = []
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, found in want.items():
        assert got[i]["n_matches"] == len(found)
        assert got[i]["license"] == (found[0][1] if found else None)
        places = [(int(at[1:]), name) for at, name in (x.split(":") for x in got[i]["matches"].split(",") if x)]
        assert [n for _, n in places] == [n for _, n in found] and all(abs(a - b) < 3 for (a, _), (b, _) in zip(places, found))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_every_match_has_a_telling_bigram(threshold):
    rng = random.Random(5)
    for notice in [*licenses.TEMPLATES.values(), "one two three four", "one two", "one", ""]:
        own, telling = licenses.bigrams(notice), set(licenses.signature(notice, threshold))
        assert telling <= set(own) and bool(telling) == bool(own)
        for _ in range(200):
            found = set(rng.sample(own, rng.randint(0, len(own))))
            if own and 2 * len(found) >= threshold * (len(found) + len(own)):
                assert found & telling
        # all but the telling ones are too few to match
        assert not own or 2 * len(set(own) - telling) < threshold * (2 * len(own) - len(telling))


def test_telling_bigrams_are_found_as_whole_words():
    pattern = regex.compile(licenses._any_of(["mit license", "mit licenses", "the mit", "bsd 3"]))
    for text in (" mit license ", " (mit)\n# license: ", " a mit\t-- licenses. ", " the mit\n", " bsd-3 "):
        assert pattern.search(text)
    for text in (" mitlicense ", " emit license ", " mit licensed ", " mit the license ", " bsd 35 ", "", " "):
        assert not pattern.search(text)
    assert not regex.search(licenses._any_of([]), " the mit license ")
