"""Whole computations: marts, flags, scores, checks against outcomes, enrichment, quality, exports."""
