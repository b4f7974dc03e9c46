"""Calls of a judge that fails now and then, and runs that are gone on with."""

import time
from pathlib import Path

import pytest
from pulsegrid.operators import dialogue


def flaky(folder, failures):
    """A judge that fails so many times for each prompt, and notes each call in a file of its own."""

    def call(prompt):
        import uuid

        Path(folder, f"{prompt}-{uuid.uuid4().hex}").write_text(str(time.time()))
        if len(list(Path(folder).glob(f"{prompt}-*"))) <= failures.get(prompt, 0):
            raise OSError("busy")
        return "" if prompt == "p5" else f" {prompt}!"

    return call


def calls(folder, prompt="*"):
    return sorted(float(p.read_text()) for p in Path(folder).glob(f"{prompt}-*"))


def prompts(spark, n=6):
    return spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(n)], "key string, prompt string")


def test_failed_calls_are_tried_again_and_answers_kept(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    call, folder = flaky(str(tmp_path / "calls"), {"p1": 1, "p2": 3}), str(tmp_path / "answers")
    assert dialogue.answers(spark, folder).count() == 0
    ask = lambda n=6: {r.key: r.answer for r in dialogue.asked(prompts(spark, n), call, folder, wait=0.1).collect()}
    want = {f"k{i}": f" p{i}!" for i in range(5)} | {"k5": ""}
    assert ask() == want
    at = calls(tmp_path / "calls", "p2")
    # waits of one, two and three times so long
    assert len(at) == 4 and at[1] - at[0] >= 0.1 and at[2] - at[1] >= 0.2 and at[3] - at[2] >= 0.3
    assert [len(calls(tmp_path / "calls", f"p{i}")) for i in range(6)] == [1, 2, 4, 1, 1, 1]
    # again: nothing twice, but for the empty answer, which was not kept
    assert ask() == want and [len(calls(tmp_path / "calls", f"p{i}")) for i in range(6)] == [1, 2, 4, 1, 1, 2]
    assert {r.key: r.answer for r in dialogue.answers(spark, folder).collect()} == {k: v for k, v in want.items() if v}


def test_run_that_breaks_off_keeps_what_it_has(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    folder = str(tmp_path / "answers")
    with pytest.raises(Exception, match="busy"):
        dialogue.asked(prompts(spark), flaky(str(tmp_path / "calls"), {"p3": 99}), folder, tries=4, wait=0.01, parts=1).collect()
    assert len(calls(tmp_path / "calls", "p3")) == 4
    kept = {r.key for r in dialogue.answers(spark, folder).collect()}
    got = {r.key: r.answer for r in dialogue.asked(prompts(spark), flaky(str(tmp_path / "calls"), {}), folder, wait=0.01, parts=1).collect()}
    assert got["k3"] == " p3!" and all(len(calls(tmp_path / "calls", f"p{k[1:]}")) == 1 for k in kept)


def test_answer_in_the_end_and_rate(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    folder = str(tmp_path / "answers")
    began = time.time()
    got = {r.key: r.answer for r in dialogue.asked(prompts(spark, 5), flaky(str(tmp_path / "calls"), {"p0": 99}), folder, tries=3, wait=0.01, per_second=10.0, parts=1, otherwise="0").collect()}
    at = calls(tmp_path / "calls")
    assert got["k0"] == "0" and len(at) == 7 and min(b - a for a, b in zip(at, at[1:])) >= 0.095 and time.time() - began >= 0.6
    assert "k0" not in {r.key for r in dialogue.answers(spark, folder).collect()}
