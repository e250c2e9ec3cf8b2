"""Detector audits on spatial point data, expressed as Spark DataFrame plans."""

from .plans.leaderboard import leaderboard
from .plans.score import Alarms, Benchmark, ScoreFrames, score
from .sources.alarms import from_table, load_alarms
from .sources.corpus import load_benchmark

__version__ = "0.1.0"
__all__ = ["Alarms", "Benchmark", "ScoreFrames", "from_table", "leaderboard", "load_alarms", "load_benchmark", "score"]
