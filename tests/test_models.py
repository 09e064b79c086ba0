"""The inference cache, and functions of users."""

import pandas as pd
import pytest

from quern.functions import models, user


def test_cache_calls_once_for_each_new_value():
    calls = []

    def twice(x):
        calls.append(x.tolist())
        return [v * 2 for v in x]

    cache = models.InferenceCache(entries=3)
    assert cache.call(twice, (pd.Series([1, 2, 1, 1]),)) == [2, 4, 2, 2]
    assert cache.call(twice, (pd.Series([2, 3]),)) == [4, 6]
    assert calls == [[1, 2], [3]] and len(cache.held) == 3


def test_cache_drops_the_least_recently_used_and_the_old():
    now = [0.0]
    cache = models.InferenceCache(entries=2, ttl=10, clock=lambda: now[0])
    cache.put((1,), "a")
    cache.put((2,), "b")
    assert cache.get((1,)) == "a"
    cache.put((3,), "c")
    assert cache.get((2,)) is None and cache.get((1,)) == "a"
    now[0] = 11
    assert cache.get((1,)) is None and cache.get((3,)) is None and not cache.held


def test_cache_is_bounded_in_bytes():
    cache = models.InferenceCache(most_bytes=2000)
    for k in range(100):
        cache.put((str(k) * 50,), k)
    assert cache.bytes <= 2000 and 0 < len(cache.held) < 30
    assert cache.bytes == sum(size for _, size, _ in cache.held.values())


def test_embedding_of_odd_texts():
    got = models.hash_embedding(pd.Series([None, "", "a", "A a", "b"]), 8)
    assert not got[0].any() and not got[1].any() and (got[2] == got[3]).all()
    assert all(abs(float((v**2).sum()) - 1) < 1e-6 for v in got[2:])


@pytest.mark.parametrize("text", ["CREATE FUNCTION f(x INT) RETURNS INT RETURN x + 1", "create or replace function f (x INT, y STRING) returns STRING as concat(x, y);"])
def test_create_function_text(text):
    m = user.CREATE.fullmatch(text)
    assert m and m[1] == "f" and m[4].strip("; ")
