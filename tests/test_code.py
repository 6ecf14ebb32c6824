from tessera.sources import code

SOURCE = '''
import os.path, json
from a.b import c
from . import d

class K:
    """Doc."""

    @deco(1)
    def m(self, x: int) -> int:
        """Says m."""
        try:
            if x and os or json:
                return helper(x)
        except (ValueError, KeyError):
            self.other()
        return [y for y in x]

def helper(v):
    eval(v)
    subprocess.run(v, shell=True)
    run(v)
    getattr(v, "z")()
    pickle.loads(v)
    __import__(v)
'''


def test_parse(spark):
    files = code.parsed(spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, code string"))
    assert [(r.module, r.line) for r in code.imports(files).collect()] == [("os", 2), ("json", 2), ("a", 3)]
    found = {r.symbol: r for r in code.symbols(files).collect()}
    assert set(found) == {"K", "K.m", "helper"}
    m = found["K.m"]
    assert (m.args, m.returns, m.decorators, m.handlers, m.docstring, m.complexity, m.typed) == (["self", "x: int"], "int", ["deco(1)"], ["(ValueError, KeyError)"], "Says m.", 1 + 1 + 1 + 1 + 2, True)
    assert not found["helper"].typed
    made = {(r.caller, r.callee): r.confidence for r in code.calls(files).collect()}
    assert made["K.m", "helper"] == "PROVEN" and made["K.m", "self.other"] == "INFERRED" and made["helper", "getattr"] == "UNKNOWN"
    assert sorted((r.callee, r.severity) for r in code.dangerous(files).collect()) == [("__import__", "MEDIUM"), ("eval", "CRITICAL"), ("pickle.loads", "HIGH"), ("subprocess.run", "HIGH")]


def test_logic_hash_ignores_the_docstring():
    one, two, three = (code.parse("p", f"def f():\n    '''{d}'''\n    return {v}")["symbols"][0]["logic"] for d, v in (("a", 1), ("b", 1), ("a", 2)))
    assert one == two != three


def test_classified(spark):
    table = lambda *x: spark.createDataFrame([(v,) for v in x], "module string")
    got = {r.module: r.kind for r in code.classified(table("os", "mine", "lib", "none"), table("os", "mine"), table("mine"), table("lib", "os")).collect()}
    assert got == {"os": "STDLIB", "mine": "STDLIB", "lib": "THIRD_PARTY", "none": "UNKNOWN"}
