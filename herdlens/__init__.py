"""Pose-tracking analytics on Spark: repair, kinematics, social features, behaviours, bouts, bins and metrics."""
