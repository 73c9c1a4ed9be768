"""Cross-operator helpers: skew-safe ordering, checkpoints, stage chains."""
