import cases
from loopstats.llm import common as C, licenses as N

MIT = N.KNOWN[15][1]


def found(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = N.scan(cases.frame(spark, rows, clashes=True), N.known_table(spark), C.scratch(spark)).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.license, r.licenses) for r in got}


def test_forms_of_one_licence(spark):
    got = found(spark, [
        MIT, MIT.upper(), "Copyright (c) 2020 Someone\n\n" + MIT + "\n", MIT.replace("copyright holders", "copyright  holders").replace(" ", "\n * "),
        MIT.replace("sublicense", "sub-licence"), MIT + " More.", "intro text\n\n" + MIT.split("\n\n")[0] + "\n\nend",
    ])
    assert [got[i][0] for i in range(5)] == ["MIT"] * 5
    assert got[5] == (None, None) and got[6] == (None, None)


def test_notices_as_lines(spark):
    got = found(spark, [
        "Released under the MIT License.\nother words", "x\nLICENSED UNDER THE APACHE LICENCE, V2.0\ny", "Licensed under CC BY-NC 4.0.",
        "Released under the MIT License and more.", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "This text has no licence",
    ])
    assert got == {
        0: (None, "MIT"), 1: (None, "Apache-2.0"), 2: ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), 3: (None, None), 4: (None, "CC-BY-NC-4.0,MIT"), 5: (None, None),
    }


def test_awkward_rows(spark):
    rows = cases.edge_rows()
    got = N.scan(cases.frame(spark, rows, clashes=True), N.known_table(spark), C.scratch(spark)).collect()
    assert len(got) == len(rows) and all(r.license is None and r.licenses is None for r in got)
    assert N.scan(cases.empty(spark), N.known_table(spark), C.scratch(spark)).count() == 0


def test_full_texts_in_altered_form(spark):
    full = {i: t for i, t in N.KNOWN if len(t) > 600}
    need = {"BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense"}
    assert need <= set(full)
    texts = [(i, t) for i, t in N.KNOWN if len(t) > 600]
    altered = [
        lambda t: "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + t, lambda t: t.upper(),
        lambda t: "\n".join(" * " + line for line in t.replace(",", " ,").split("\n")),
    ]
    got = found(spark, [f(t) for _, t in texts for f in altered] + [t + " More." for t in full.values()])
    assert [got[i][0] for i in range(3 * len(texts))] == [i for i, _ in texts for _ in altered]
    assert all(got[i][0] is None for i in range(3 * len(texts), len(got)))


def test_a_digest_has_one_licence(spark):
    rows = N.known_table(spark).collect()
    assert len({r.digest for r in rows}) == len(rows)
