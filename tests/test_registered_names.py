"""Every name that a registered query looks up exists in its module."""

import builtins
import dis

import pytest

from knockon.plans import catalog


def _globals_read(code):
    for step in dis.get_instructions(code):
        if step.opname == "LOAD_GLOBAL":
            yield step.argval
    for inner in code.co_consts:
        if hasattr(inner, "co_code"):
            yield from _globals_read(inner)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_reads_known_names(name):
    fn = catalog.QUERIES[name]
    known = {*vars(builtins), *fn.__globals__}
    assert set(_globals_read(fn.__code__)) <= known
