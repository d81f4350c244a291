"""The registered model and regime queries take the reference's settings."""
import inspect

import pytest

from cyclewise.operators import boosting as B
from cyclewise.plans import q_models as Q
from cyclewise.plans import q_regimes as QR

SF = "/root/testdata/sf0.001"


def test_boosting_takes_the_reference_settings_and_its_pick(spark, monkeypatch):
    defaults = {k: p.default for k, p in inspect.signature(B.BoostingRun.__init__).parameters.items()}
    assert (defaults["rounds"], defaults["depth"], defaults["patience"]) == (2000, 6, 40)
    assert (defaults["learning_rate"], defaults["subsample"], defaults["colsample"], defaults["reg_lambda"]) == (
        0.05, 0.8, 0.8, 1.0)
    runs = []

    def short(real):
        def boost(*args, **kw):
            assert not kw  # the queries change no setting
            runs.append(real(*args, rounds=3, **kw))
            return runs[-1]
        return boost

    monkeypatch.setattr(Q.M, "boost", short(Q.M.boost))
    monkeypatch.setattr(Q.M, "boost_folds", short(Q.M.boost_folds))
    monkeypatch.setattr(Q, "_MEMO", {})
    best = Q.gbt_tree_selection(spark, SF).first().best_tree_count
    assert 1 <= best <= 3 and len(runs[0].model("final").trees) == best
    rows = Q.gbt_cross_validation(spark, SF).collect()
    assert sorted(r.fold for r in rows) == [-1, 0, 1, 2, 3, 4]
    assert {r.fold: r.trees for r in rows if r.fold >= 0} == {f: runs[1].tasks[f].best for f in range(5)}
    assert {r.model for r in Q.model_comparison(spark, SF).collect()} == {"gbt", "random_forest", "linear"}
    assert len(runs) == 2


def test_sweep_takes_twenty_restarts(spark, monkeypatch):
    class Seen(Exception):
        pass

    def sweep(df, features, ks, restarts):
        assert restarts == 20 and list(ks) == list(range(2, 11))
        raise Seen

    monkeypatch.setattr(QR.R, "sweep_regimes", sweep)
    monkeypatch.setattr(QR, "_SWEEPS", {})
    with pytest.raises(Seen):
        QR.regime_sweep(spark, SF)
