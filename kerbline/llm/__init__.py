"""Operations of a training-data pipeline over text corpora."""
