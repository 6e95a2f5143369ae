"""Relational operators over places, reviews and annotations; all keyed by place_id."""
