"""Panel local projections on Spark."""

from impulsar.estimator import FewClustersWarning, LocalProjection
from impulsar.plans.terms import C, fe, interact
from impulsar.plotting import plot_irf
from impulsar.progress import ProgressEvent
from impulsar.sources.panel import period_index

__version__ = "0.1.0"
__all__ = ["C", "FewClustersWarning", "LocalProjection", "ProgressEvent", "fe", "interact", "period_index", "plot_irf"]
