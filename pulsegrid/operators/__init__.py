"""Composable operators on long tables keyed by rec_id."""
