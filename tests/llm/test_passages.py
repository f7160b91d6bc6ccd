"""Long lines that repeat between unique neighbours, against brute force and in the pipeline."""

import re

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE, SHORT = " ".join(f"w{k}" for k in range(34)) + "  last", " ".join(f"s{k}" for k in range(34))
TEXTS = [
    f"a0\n{PASSAGE}\nb0\n{SHORT}\nc0", f"a1\n{SHORT}\nb1\n{PASSAGE}\nc1", f"a2\n \n{PASSAGE}\nb2\n{PASSAGE}", None, "", PASSAGE,
    f"a6\n{PASSAGE.upper()}\nb6", f"a1\n{SHORT}\nx\n{PASSAGE} more",
]


def test_line_dedup_takes_long_single_lines(spark):
    want, runs, singles = {}, set(), set()
    for k, text in enumerate(TEXTS):
        lines = (text or "").split("\n")
        named = [n for n, x in enumerate(lines) if x.strip()]
        gone = set()
        for at, n in enumerate(named):
            if len(re.split(r"\s+", lines[n])) >= 35:
                if lines[n] in singles:
                    gone.add(n)
                singles.add(lines[n])
            if at + 1 < len(named):
                run = (lines[n], lines[named[at + 1]])
                if run in runs:
                    gone |= {n, named[at + 1]}
                runs.add(run)
        if not gone or len(gone) < len(named):
            want[k] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    assert 5 not in want and PASSAGE not in want[1] and PASSAGE not in want[2] and SHORT in want[1] and SHORT not in want[7]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)], SCHEMA)
    got = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
