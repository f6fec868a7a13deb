"""The compressed equilibrium problem: evaluators, solvers and the outer loop."""
