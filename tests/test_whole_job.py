"""What the reviewed queries once left out."""

import numpy as np
import pytest

from tessera.operators import matrix
from tessera.plans import queries as toolkit

SF = "/root/testdata/sf0.001"


def test_conjugate_gradient_query_solves_its_system(spark):
    m = np.zeros((50, 40))
    for c, o, v in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice").collect():
        m[c % 50, o % 40] += v / 1000
    a = m @ m.T + 1e4 * np.eye(50)
    got = toolkit.queries()["matrix_conjugate_gradient"](spark, SF).orderBy("i").collect()
    x = np.array([r["v"] for r in got])
    assert [r["i"] for r in got] == list(range(50))
    assert np.linalg.norm(a @ x - 1) <= 2e-6 * 50**0.5 and np.allclose(x, np.linalg.solve(a, np.ones(50)), rtol=1e-3, atol=1e-10)


def test_conjugate_gradient_raises_when_steps_run_out(spark):
    a = matrix.from_rows(spark, [[4.0, 1.0], [1.0, 3.0]])
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")
    with pytest.raises(ArithmeticError, match="after 1 steps"):
        matrix.conjugate_gradient(a, b, most=1)
    with pytest.raises(ArithmeticError, match="positive definite"):
        matrix.conjugate_gradient(matrix.scale(a, -1.0), b)


def test_conjugate_gradient_on_tables(spark, monkeypatch):
    monkeypatch.setattr(matrix, "_on_driver", lambda a, b: None)
    a = matrix.from_rows(spark, [[4.0, 1.0, 0.0], [1.0, 3.0, 0.5], [0.0, 0.5, 2.0]])
    b = spark.createDataFrame([(0, 1.0)], "i long, v double")
    x = {r["i"]: r["v"] for r in matrix.conjugate_gradient(a, b, jacobi=True).collect()}
    assert np.allclose([x[0], x[1], x[2]], np.linalg.solve([[4, 1, 0], [1, 3, 0.5], [0, 0.5, 2]], [1, 0, 0]))
