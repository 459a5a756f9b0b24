from tallyframe.plans.analyse import analyse_errors
from tallyframe.plans.compare import compare_runs
from tallyframe.plans.evaluate import evaluate_scores
from tallyframe.plans.prepare import prepare

__all__ = ["analyse_errors", "compare_runs", "evaluate_scores", "prepare"]
