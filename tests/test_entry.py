"""The driver's contract: importable without a session, SQL only for known queries."""

import subprocess
import sys


def test_contract():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and all(map(callable, q.values())); print(len(q), len(o))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 80


def test_the_rest_does_not_need_the_llm_subpackage():
    code = "import sys; sys.modules['marlstone.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q in ('p3_found', 'p10_found')] and 'p5_found' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0
