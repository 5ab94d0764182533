"""Scopes of written tables: what goes, what stays, and that threads don't meet."""

from __future__ import annotations

import os
import threading

import pytest

from quillspark import state


def there(path):
    return os.path.isdir(path.removeprefix("file://"))


def test_scopes_keep_what_is_read(spark):
    with state.scope(spark) as outer:
        with state.scope(spark) as own:
            a, b = state.materialise(spark.range(3), "a"), state.materialise(spark.range(4), "b")
            joined = a.join(state.materialise(spark.range(2), "c"), "id")
            paths = list(own.paths)
            own.keep(joined)
        assert [there(p) for p in paths] == [True, False, True] and outer.paths == [paths[0], paths[2]] and joined.count() == 2
        with state.scope(spark) as own:
            own.adopt(joined)
            d = state.materialise(joined, "d")
            own.keep(d)
        assert not there(paths[0]) and not there(paths[2]) and d.count() == 2 and len(outer.paths) == 1
        e = state.materialise(d, "e", instead_of=d)
        assert e.count() == 2 and len(outer.paths) == 1
    assert not there(outer.paths[0])


def test_an_operator_that_fails_leaves_nothing(spark):
    seen = []

    @state.scoped
    def operator(df, fail):
        seen.append(state.materialise(df, "x"))
        if fail:
            raise ValueError
        return seen[-1].filter("id > 0"), 7

    before = len(state.written)
    with pytest.raises(ValueError):
        operator(spark.range(3), True)
    assert len(state.written) == before and not there(seen[0].inputFiles()[0].rsplit("/", 1)[0])
    out, n = operator(spark.range(3), False)
    assert (out.count(), n, len(state.written)) == (2, 7, before + 1)
    state.discard(spark, state.written[before:])
    assert len(state.written) == before


def test_threads_have_scopes_of_their_own(spark):
    ready, counts = threading.Barrier(3), []

    def run(n):
        with state.scope(spark) as own:
            kept = state.materialise(spark.range(n), "t")
            ready.wait()
            counts.append((n, kept.count(), len(own.paths)))
            ready.wait()
            gone = own.paths[0]
        counts.append(there(gone))

    threads = [threading.Thread(target=run, args=(n,)) for n in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(c for c in counts if c) == [(1, 1, 1), (2, 2, 1), (3, 3, 1)] and counts.count(False) == 3
