"""Operations of a training-data pipeline: dedup, joins, language, secrets, quality, token output, packing, sharding."""
