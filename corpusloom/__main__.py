from corpusloom.cli import main

main()
