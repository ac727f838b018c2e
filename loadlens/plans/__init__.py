"""Printed execution plans: stored plan rows laid out as indented text."""

from loadlens.plans.printed import (
    plan_lines,
    plan_monitor_report,
    plan_tree,
    plan_tree_with_actuals,
)

__all__ = ["plan_lines", "plan_monitor_report", "plan_tree", "plan_tree_with_actuals"]
