"""Release planning for warehouse drops on Spark."""

from waveplan.operators.capacity import Scenario
from waveplan.plans.planner import Rules, WavePlan, plan_waves
from waveplan.plans.scenarios import scenario_best, scenario_sweep

__all__ = ["Rules", "Scenario", "WavePlan", "plan_waves", "scenario_best", "scenario_sweep"]
