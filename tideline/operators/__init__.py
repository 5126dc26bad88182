"""DataFrame operators over long (subject, time, feature, value) and (feature, sample, value) tables."""
