import random
import time

import pytest
import zstandard

from cairnlake.llm import licenses
from cairnlake.llm.licenses import LEAST_GAIN, MOST_DIFFERENT, TEMPLATES, Scanner, scan_licenses, words_in

#: Those that brute force can go through.
SHORT = {name: text for name, text in TEMPLATES.items() if len(text.split()) < 30}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def size(words, template=None):
    data = template and zstandard.ZstdCompressionDict(" ".join(template).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=data or None).compress(" ".join(words).encode()))


def brute(text):
    """Every window that some template confirms: (start, end, template, differing words, saved), with no prefilter."""
    words, out = words_in(text), []
    said = [w for w, _, _ in words]
    for name, wording in SHORT.items():
        want = [w for w, _, _ in words_in(wording)]
        limit = int(MOST_DIFFERENT * len(want))
        for start in range(len(said)):
            for stop in range(start + max(1, len(want) - limit), min(len(said), start + len(want) + limit) + 1):
                have = said[start:stop]
                n = distance(want, have)
                if n <= limit:
                    plain = size(have)
                    saved = plain - size(have, want)
                    if saved >= LEAST_GAIN * min(plain, len(" ".join(want))):
                        out.append((words[start][1], words[stop - 1][2], name, n, saved))
    return out


def notices(seed):
    """Filler with notices between, some with words changed, left out or put in, wrapped and in other case."""
    rng = random.Random(seed)
    filler = "the of river license version permission under rights stone general public work is in and software this was".split()
    parts = []
    for _ in range(rng.randint(1, 3)):
        parts += rng.choices(filler, k=rng.randint(0, 8))
        words = rng.choice(list(SHORT.values())).split()
        for _ in range(rng.randint(0, max(1, len(words) // 5))):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"]])
        parts += words
    parts += rng.choices(filler, k=4)
    return "".join(w + rng.choice([" ", " ", " ", "\n", "\n * "]) for w in parts)


@pytest.mark.parametrize("seed", range(60))
def test_findings_are_those_of_all_windows_and_templates(seed):
    text = notices(seed)
    every, got = brute(text), Scanner(SHORT).scan(text)
    meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
    assert all(not meets(a, b) for a, b in zip(got, got[1:], strict=False))
    for start, end, name, _, n, _ in got:  # each finding is a window that confirms, and none there has fewer differences
        alike = [w[3] for w in every if w[2] == name and meets(w, (start, end)) and not any(meets(w, o) for o in got if o[:3] != (start, end, name))]
        assert any(w[:3] == (start, end, name) and w[3] == n for w in every)
        assert n <= min(alike, default=n)
    for window in every:  # nothing that confirms lies apart from all findings
        assert any(meets(window, g) for g in got), window
    if every:  # what saves most of all is found, or what beats it where they overlap
        best = max(every, key=lambda w: w[4])
        assert any(meets(best, g) and (g[2] == best[2] or g[3] > 0) for g in got)


def test_exact_altered_and_unrelated_wordings():
    scan = Scanner(TEMPLATES).scan
    for name, text in TEMPLATES.items():
        hits = scan(f"first line\n{text}\nlast line")
        assert [(h[2], h[4]) for h in hits] == [(name, 0)], name
    altered = scan("This work is licensed under the GNU General Public License, version 2.")
    assert [(h[2], h[4]) for h in altered] == [("GPL-3.0", 1)] and "[-3-]{+2+}" in altered[0][5]
    assert scan("She released the bird under the tree; permission was granted by the general public.") == []
    assert scan(None) == [] and scan("") == []


def test_notice_inside_a_long_line_is_located():
    text = "lorem ipsum dolor " * 3000 + TEMPLATES["Apache-2.0"] + " sit amet" * 3000
    (hit,) = Scanner(TEMPLATES).scan(text)
    assert text[hit[0] : hit[1]].startswith("Licensed under the Apache") and hit[2] == "Apache-2.0" and hit[4] == 0


def test_rows(spark, docs):
    rows = [(1, TEMPLATES["MIT"]), (1, TEMPLATES["MIT"]), (None, TEMPLATES["MIT"]), (2, None), (3, "")]
    got = scan_licenses(docs(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"] and {r["license"] for r in got} == {"MIT"}
    assert scan_licenses(docs([])).count() == 0


def test_short_and_reworded_notices_pass_the_prefilter():
    scan = lambda text: [(h[2], h[4]) for h in Scanner(TEMPLATES).scan(text)]
    assert scan("some words\nAll rights reserved.\nmore words") == [("All-Rights-Reserved", 0)]
    assert scan("All rights reserved. No part of this work may be copied without consent") == [("Proprietary", 2)]
    assert scan(TEMPLATES["Proprietary"]) == [("Proprietary", 0)]
    scanner = Scanner(TEMPLATES)
    for name, words in scanner.wordings.items():  # whichever words differ, as many as may
        limit = scanner.limits[name]
        for at in range(len(words) - limit + 1) if limit else ():
            text = " ".join([*words[:at], *["zzz"] * limit, *words[at + limit :]]).lower()
            assert any(w in text for w in scanner.rare), text
            assert name in {found for found, _, _ in scanner.stretches(text.split())}, text


def test_wrapped_notices_and_several_on_a_line():
    scan = lambda text: [(h[2], h[4]) for h in Scanner(TEMPLATES).scan(text)]
    assert scan("Licensed under the Apache License,\nVersion 2.0.") == [("Apache-2.0", 0)]
    wrapped = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n"
    assert scan(wrapped) == [("BSD-3-Clause", 0)]
    both = "Licensed under the Apache License, Version 2.0. Released under the MIT License."
    (first, second) = Scanner(TEMPLATES).scan(both)
    assert (first[2], second[2]) == ("Apache-2.0", "MIT") and both[second[0] : second[1]] == "Released under the MIT License"
    assert scan("Licensed under the Apache License, Version. Released under the MIT License.") == [("Apache-2.0", 1), ("MIT", 0)]
    every = [name for name in sorted(TEMPLATES)]
    assert scan(" ".join(TEMPLATES[name] for name in every)) == [(name, 0) for name in every]
    assert scan("\n".join([TEMPLATES["MIT"]] * 50)) == [("MIT", 0)] * 50


def test_whole_texts_are_found_with_words_changed():
    scan = Scanner(TEMPLATES).scan
    for name in ("MIT-Notice", "ISC", "GPL-3.0-Notice", "Apache-2.0-Notice"):
        words = TEMPLATES[name].split()
        for k in range(7, len(words), 11):
            words[k] = "altered"
        text = "# " + "\n# ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        (hit,) = scan(f"Some header words\n{text}\nint main() {{ return 0; }}")
        assert hit[2] == name and hit[4] == len(range(7, len(words), 11))


def test_costs_are_those_of_the_plain_recurrence():
    draw = random.Random(4)
    for _ in range(60):
        want, have = draw.choices("abcd", k=draw.randint(1, 12)), draw.choices("abcde", k=draw.randint(0, 15))
        plain = [[0] * (len(have) + 1)]
        for i, w in enumerate(want):
            row = [i + 1]
            for j, h in enumerate(have):
                row.append(min(plain[-1][j] + (w != h), plain[-1][j + 1] + 1, row[j] + 1))
            plain.append(row)
        assert licenses.costs(want, have).tolist() == plain


def test_whole_licenses_take_moments():
    mit = licenses.TEMPLATES[next(n for n, t in licenses.TEMPLATES.items() if t.startswith("Permission is hereby granted"))]
    scanner = licenses.Scanner(licenses.TEMPLATES)
    scanner.scan(mit)
    began = time.process_time()
    found = scanner.scan(" own words between ".join([mit] * 20))
    assert len(found) >= 20 and time.process_time() - began < 6
