"""Reading and writing records, trajectories, conflicts and calibrations."""
