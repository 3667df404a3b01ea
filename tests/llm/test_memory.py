"""Word memories are bounded in bytes, whatever the words look like."""

import sys

from cotejo.llm import common
from cotejo.llm.common import Memory, kept
from cotejo.llm.toxicity_mil import Words


def size(memory):
    return sum(sys.getsizeof(w) + sys.getsizeof(v) for held in (memory.young, memory.old) for w, v in held.items())


def test_long_words_are_not_remembered():
    memory = Memory(1_000_000)
    for k in range(200):
        words = {f"{k}-" + "x" * 20_000, "short"}
        for w in memory.missing(words):
            memory.young[w] = w[:3]
        assert all(w in memory.young for w in words)  # of this call all are at hand
    assert size(memory) < 100_000 and "short" in memory.young


def test_memory_is_bounded_in_bytes():
    memory = Memory(10_000_000, most=1_000_000)
    for k in range(400):
        words = {f"word{k}-{j}" for j in range(100)} | {"often"}
        for w in memory.missing(words):
            memory.young[w] = 1.5
    assert size(memory) < 3_000_000 and ("often" in memory.young or "often" in memory.old)


def test_results_are_the_same_with_any_memory():
    small, large = Memory(3, most=400), Memory(10 ** 6)
    texts = [{"a", "bb"}, {"bb", "c" * 100}, {"c" * 100, "d"}, {"a", "d"}] * 5
    for memory in (small, large):
        for words in texts:
            for w in memory.missing(words):
                memory.young[w] = len(w)
            assert {w: memory.young[w] for w in words} == {w: len(w) for w in words}


def test_worker_keeps_one_thing():
    first = kept(("a", 1), object)
    assert kept(("a", 1), object) is first
    assert kept(("b", 1), object) is not first
    assert kept(("a", 1), object) is not first


def test_words_without_spaces_are_forgotten(monkeypatch):
    monkeypatch.setattr("cotejo.llm.toxicity_mil.MEMORY", 1_000_000)
    words, forgotten = Words(), 0
    for k in range(300):
        words.parse(f"{k}" + "字" * 20_000)
        forgotten += words.full()
        assert sum(map(len, words.words)) < 1_000_000
    assert forgotten > 2
    assert common.MEMORY > 1_000_000
