"""DataFrame operators over trajectories and conflicts."""
