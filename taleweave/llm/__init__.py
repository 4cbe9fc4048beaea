"""Operations of a training-data pipeline over the document tables. Nothing else in the library imports this package."""
